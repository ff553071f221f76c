from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.splitting import pieces

SCHEMA = "item_kind string, item_id bigint, text string, piece_index string"


def run(spark, texts, limit=20, overlap=4):
    df = spark.createDataFrame([("k", i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return pieces(df, limit, overlap).orderBy("item_id", "piece_index").collect()


def check(texts, rows, limit, overlap):
    for i, t in enumerate(texts):
        own = [r for r in rows if r["item_id"] == i]
        if t is None or len(t) <= limit:
            assert own == []
            continue
        assert own[0]["piece_start"] == 0 and own[-1]["piece_end"] == len(t)
        for r in own:
            assert r["text"] == t[r["piece_start"] : r["piece_end"]] and 0 < len(r["text"]) <= limit
        for a, b in zip(own, own[1:]):
            assert b["piece_start"] == max(0, a["piece_end"] - overlap) and b["piece_end"] > a["piece_end"]


def test_boundaries_and_offsets(spark):
    texts = [None, "", "short", "One two. Three four five. Six seven.", "para one\n\npara two\n\npara three", "没有空格的很长很长的一段文字。还有一句话在这里，再来一句话。", "x" * 95, "🙂" * 50, "a\r\nb\rc\n" * 12, "é" * 30]
    rows = run(spark, texts)
    check(texts, rows, 20, 4)
    first = [r["text"] for r in rows if r["item_id"] == 3]
    assert first[0] == "One two. "


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab .,!\n\r。，”é́🙂", max_size=150), max_size=6))
def test_any_text(spark_shared, texts):
    check(texts, run(spark_shared, texts, 15, 5), 15, 5)


def test_repeats_give_one_set(spark):
    df = spark.createDataFrame([("k", 1, "word " * 20, "")] * 3, SCHEMA)
    got = pieces(df, 30, 0).collect()
    assert len({r["piece_index"] for r in got}) == len(got)
