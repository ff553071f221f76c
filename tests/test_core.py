import datetime as dt
import io
import json
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import similarity as M
from inkloom.functions import text as T
from inkloom.operators import alignment as A
from inkloom.operators import chunking as C
from inkloom.operators import names as N
from inkloom.operators import relations as J
from inkloom.operators import scenes
from inkloom.operators import sequence as S
from inkloom.plans import model_stage
from inkloom.sources import files, sinks
from inkloom.streaming import carry


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


# -- texts and chunks ------------------------------------------------------


def packed(spark, text, budget, **how):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r["text"] for r in C.pack_sentences(df, ["id"], "text", budget, **how).orderBy("chunk_index").collect()]


def test_packing_reaches_or_crosses(spark):
    assert packed(spark, "甲乙丙。丁戊己。庚辛。", 8) == ["甲乙丙。丁戊己。", "庚辛。"]
    assert packed(spark, "这一句话很长很长。短。", 5) == ["这一句话很长很长。", "短。"]
    assert packed(spark, " \n　", 5) == [] and packed(spark, None, 5) == [] and packed(spark, "", 5) == []
    assert packed(spark, "甲乙。丙丁。戊己庚辛壬。癸。", 6, crossing=False) == ["甲乙。丙丁。", "戊己庚辛壬。", "癸。"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab。！？”\n 　!", max_size=60))
def test_sentences_lose_nothing(text):
    from inkloom.session import local_session

    spark = local_session("4")
    found = spark.createDataFrame([(text,)], "t string").select(T.split_sentences(F.col("t")).alias("s")).first()["s"]
    assert "".join(found) == (text if text.strip(" \t\n\r　") else "")


def sections(spark, text, **how):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r["volume"], r["chapter"], r["body"]) for r in C.split_sections(df, ["id"], "text", **how).orderBy("section_index").collect()]


def test_sections(spark):
    assert sections(spark, "前言\n第一章 起\n甲\n第二章 承\n乙") == [(None, "第一章 起", "甲"), (None, "第二章 承", "乙")]
    assert sections(spark, "前言\n第一卷 上\n序\n第一章 起\n甲\n第二卷 下\n乙") == [("第一卷", None, "序"), ("第一卷", "第一章 起", "甲"), ("第二卷", None, "乙")]
    assert sections(spark, "第一卷 第一章 起\n甲\n第一卷 第二章 承\n乙") == [("第一卷", "第一章 起", "甲"), ("第一卷", "第二章 承", "乙")]
    assert sections(spark, "没有标题\n两行") == [(None, None, "没有标题\n两行")]
    assert sections(spark, " \n ") == [] and sections(spark, None) == []
    assert sections(spark, "前言\n第一章 起\n甲", front_matter=True)[0] == (None, None, "前言")


def test_small_functions(spark):
    assert one(spark, T.slug(F.col("a")), a="The Old  Mill!") == "the-old-mill" and one(spark, T.slug(F.col("a")), a="雾隐村/花园") == "雾隐村-花园" and one(spark, T.slug(F.col("a")), a="..") == "dataset"
    assert one(spark, T.state_name(F.col("a")), a="Anna.位置") == "Anna.location" and one(spark, T.state_name(F.col("a")), a="a.b.c") is None
    assert one(spark, T.occurrences(F.col("a"), F.col("b")), a="aaaa", b="aa") == [0, 1, 2] and one(spark, T.occurrences(F.col("a"), F.col("b")), a="xay", b="a") == [1] and one(spark, T.occurrences(F.col("a"), F.col("b")), a="x", b="") == []
    assert one(spark, T.render("{a}-{b}-{a}", a=F.col("a"), b=F.col("b")), a="{b}", b="x") == "{b}-x-{b}"
    assert one(spark, T.repair_json(F.col("a")), a='Sure:\n```json\n{"a": [1,],}\n```') == '{"a": [1]}'
    assert one(spark, T.natural_key(F.col("a")), a="p2") < one(spark, T.natural_key(F.col("a")), a="p10")
    assert one(spark, T.is_narration(F.col("a")), a="*(　)*") is False and one(spark, T.is_narration(F.col("a")), a="*(x)*") is True and one(spark, T.is_narration(F.col("a")), a=None) is False
    assert one(spark, T.html_to_text(F.col("a")), a="<p>a</p><script>x</script> b") == "a b"
    assert one(spark, T.normalize_title(F.col("a")), a="  ") == "New chat"
    with pytest.raises(ValueError):
        T.heading_pattern([""])


# -- ordered rows ----------------------------------------------------------


def test_role_samples(spark):
    rows = [(1, 0, "Environment", "*(dusk)*"), (1, 1, "Anna", "hello"), (1, 2, "Anna", "there"), (1, 3, "Ben", "yes"), (2, 0, "Environment", "*(x)*")]
    out = S.role_samples(spark.createDataFrame(rows, "c int, i int, speaker string, content string"), ["c"], ["i"]).orderBy("target", "turn").collect()
    assert [(r["target"], r["role"], r["content"], r["loss"]) for r in out] == [("Anna", "user", "Environment：*(dusk)*", None), ("Anna", "assistant", "Anna：hello\nthere", True), ("Ben", "user", "Environment：*(dusk)*\nAnna：hello\nthere", None), ("Ben", "assistant", "Ben：yes", True)]


def test_trim_context(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 30) for i in range(6)] + [(2, 0, "user", "y" * 200)]
    df = spark.createDataFrame(rows, "s int, i int, role string, content string")
    kept = S.trim_context(df, ["s"], ["i"], F.length("content"), F.col("role") == "user", 130).collect()
    assert sorted((r["s"], r["i"]) for r in kept) == [(1, 2), (1, 3), (1, 4), (1, 5)]


def test_overlaps_prefix_and_fill(spark):
    r = spark.createDataFrame([("a", 0, 9), ("a", 3, 4), ("a", 5, 6), ("b", 0, 1), ("b", 2, 3)], "k string, s int, e int")
    assert sorted((x["s"]) for x in S.range_overlaps(r, ["k"], "s", "e").collect()) == [3, 5]
    p = {x["k"]: (x["n"], x["prefix"], x["complete"]) for x in S.contiguous_prefix(spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 1), ("c", 0)], "k string, i int"), ["k"], "i").collect()}
    assert p == {"a": (3, 2, False), "b": (1, 0, False), "c": (1, 1, True)}
    f = S.fill_positions(spark.createDataFrame([("a", 0, None), ("a", 1, 5), ("a", 2, None), ("b", 0, None)], "k string, i int, p int"), ["k"], ["i"], "p").orderBy("k", "i").collect()
    assert [x["filled"] for x in f] == [5, 5, 5, 0]


# -- names and relations ----------------------------------------------------


def test_alias_groups(spark):
    rows = [("b", 0, ["A", "B"]), ("b", 1, ["C"]), ("b", 2, ["C", "B"]), ("b", 3, []), ("b", 4, ["D"]), ("c", 5, ["A"])]
    df = spark.createDataFrame(rows, "book string, at bigint, names array<string>")
    assert {r["at"]: r["group"] for r in N.alias_groups(df, "book", "at", "names").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert {r["at"]: r["group"] for r in N.conservative_groups(df, "book", "at", "names").collect()} == {0: 0, 1: 1, 2: None, 3: 3, 4: 4, 5: 5}


def test_pending_tells_failed_from_empty(spark):
    units = spark.createDataFrame([(0,), (1,), (2,)], "i int")
    results = spark.createDataFrame([(0, "{}"), (1, None)], "i int, result string")
    assert sorted(r["i"] for r in J.pending(units, results, ["i"], "result").collect()) == [1, 2]
    best = J.best_match(spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.88)], "k int, c int, s double"), ["k"], "c", "s", 0.45, 0.05).collect()
    assert [(r["k"], r["c"]) for r in best] == [(1, 1)]


# -- similarity and alignment -----------------------------------------------


def slow_window(needle, text):
    m, n = len(needle), len(text)
    if n <= m:
        return M.ratio(needle, text)
    spans = [(s, s + m) for s in range(n - m + 1)] + [(0, e) for e in range(1, m)] + [(s, n) for s in range(n - m + 1, n)]
    return max(M.ratio(needle, text[a:b]) for a, b in spans)


@settings(max_examples=80, deadline=None)
@given(st.text("abcd", min_size=1, max_size=8), st.text("abcd", min_size=1, max_size=25))
def test_best_window(needle, text):
    got = M.best_window(needle, text)
    assert got[0] == pytest.approx(slow_window(needle, text)) and 0 <= got[1] < got[2] <= len(text)
    if needle in text:
        assert got[0] == 100


@settings(max_examples=50, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_ratio_is_the_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert M.common_length(a, b) == table[-1][-1]


def test_best_edit():
    assert M.best_edit("kitten", "a kitten sat") == (1.0, 2, 8)
    found = M.best_edit("the old mill", "near the odl mill we met")
    assert found and found[0] >= 0.8 and "mill" in "near the odl mill we met"[found[1] : found[2]]
    assert M.best_edit("", "x") is None and M.best_edit("xyz", "abc") is None


def test_alignment_moves_forward():
    text = "甲说你好。乙说你好。丙走了。"
    assert A.align_lines(text, [("甲", "你好"), ("乙", "你好"), ("丙", "你好")]) == [(2, 4), (7, 9), None]
    assert A.align_lines(text, [("Environment", "*(你好)*"), ("丙", "甲说")]) == [None, (0, 2)]
    assert A.align_lines("", [("a", "x")]) == [None]
    assert A.place_units("One two three. Four!", [("a", "one"), ("a", "two three"), ("b", "four"), ("b", "?")]) == [(0, None), (4, None), (15, None), (None, "no letters")]
    assert A.match_ocr(["hello there", "bye"], ["hallo there", "zzz"]) == [0, None]
    assert A.match_turns([("x", "A"), ("x", "A")], [("x", ["B"]), ("x", ["A"])]) == [1, None]


def test_scenes():
    chunks = [(0, "ab cd", "s"), (1, "ef gh", "s")]
    assert scenes.rebuild(chunks, [[("cd", None)], []]) == [[(0, 3, 5), (1, 0, 5)]]
    assert scenes.rebuild(chunks, [[], []]) == [[(0, 0, 5), (1, 0, 5)]]
    assert scenes.rebuild([(0, "ab", "s"), (1, "cd", "t")], [[], []]) == [[(0, 0, 2)], [(1, 0, 2)]]
    assert scenes.rebuild(chunks, [[("ab", "ab"), ("cd", None)], [(None, "ef"), ("gh", "gh")]]) == [[(0, 0, 2)], [(0, 3, 5), (1, 0, 2)], [(1, 3, 5)]]
    with pytest.raises(scenes.BoundaryError):
        scenes.rebuild(chunks, [[("zz", None)], []])


def test_positions_of_several_scopes_stay_apart(spark):
    rows = [("f", 0, ["A"]), ("f", 1, ["B"]), ("g", 0, ["C"]), ("g", 1, ["C"]), ("g", 2, []), ("g", 3, None)]
    df = spark.createDataFrame(rows, "file string, at bigint, names array<string>")
    got = {(r["file"], r["at"]): r["group"] for r in N.alias_groups(df, "file", "at", "names").collect()}
    assert got == {("f", 0): 0, ("f", 1): 1, ("g", 0): 0, ("g", 1): 0, ("g", 2): 2, ("g", 3): 3}


def test_conservative_groups_against_one_fold(spark):
    import random

    rng = random.Random(2)
    rows = [("b" if i % 3 else "c", i, sorted({f"n{rng.randint(0, 25)}" for _ in range(rng.randint(0, 3))})) for i in range(60)]
    owners: dict = {}
    want = {}
    for scope, at, own in rows:
        touched = {owners[scope, n] for n in own if (scope, n) in owners}
        want[at] = None if len(touched) > 1 else next(iter(touched), at)
        if want[at] is not None:
            owners.update({(scope, n): want[at] for n in own})
    df = spark.createDataFrame(rows, "book string, at bigint, names array<string>")
    assert {r["at"]: r["group"] for r in N.conservative_groups(df, "book", "at", "names").collect()} == want


def test_recovered_scenes():
    chunks = [(0, "ab cd", "s"), (1, "ef gh", "s"), (2, "ij kl", "t")]
    # A truncated chunk's end doesn't count; a finished chunk without one stays open; the next mark closes whatever its start.
    done, notes = scenes.recover(chunks, [[("ab", "ab")], [("ef", "ef")], [("ij", "kl")]], [True, False, False])
    assert done == [[(0, 0, 5), (1, 0, 2)], [(2, 0, 5)]] and [p for p, _ in notes] == [0, 1]
    done, _ = scenes.recover(chunks, [[("cd", None)], [], [(None, "ij")]], [False, True, False])
    assert done == [[(0, 3, 5), (1, 0, 5), (2, 0, 2)]]
    # A scene without a start joins the one before it, in its chunk or in the last with marks.
    done, _ = scenes.recover(chunks[:2], [[("ab", "ab"), (None, "cd")], [("ef", "gh")]], [False, False])
    assert done == [[(0, 0, 5)], [(1, 0, 5)]]
    done, notes = scenes.recover(chunks[:2], [[("ab", "cd")], [(None, "ef"), ("gh", "gh")]], [False, False])
    assert done == [[(0, 0, 5), (1, 0, 2)], [(1, 3, 5)]] and any("goes on" in what for _, what in notes)
    for marks, states in (([[("zz", None)]], [True]), ([[]], [True]), ([[(None, "ab")]], [False]), ([[("ab", None)]], [True]), ([[("ab", None), ("cd", "cd")]], [False])):
        with pytest.raises(scenes.BoundaryError):
            scenes.recover(chunks[:1], marks, states)
    assert scenes.recover(chunks[:1], [[("ab", None)]], [True], incomplete=True)[0] == []
    assert scenes.recover([], [], []) == ([], [])


def test_recovered_scenes_as_rows(spark):
    marks = "array<struct<start: string, end: string>>"
    rows = [("b", 0, "ab cd", "s", [("ab", None)], True), ("b", 1, "ef gh", "s", [(None, "ef"), ("gh", "gh")], False), ("c", 0, "xy", "s", [("zz", None)], True)]
    df = spark.createDataFrame(rows, f"book string, pos int, text string, section string, marks {marks}, cut boolean")
    got = scenes.rebuild_scenes(df, ["book"], "pos", "section", "marks", "cut").orderBy("book", "scene", "piece").collect()
    assert [(r["book"], r["scene"], r["piece"], r["position"], r["span_start"], r["span_end"]) for r in got[:3]] == [("b", 0, 0, 0, 0, 5), ("b", 0, 1, 1, 0, 2), ("b", 1, 0, 1, 3, 5)]
    assert got[3]["book"] == "c" and "zz" in got[3]["error"] and len(got) == 4


def test_rebuilt_scenes_are_numbered_over_sections(spark):
    rows = [("b", 0, "ab", "s", []), ("b", 1, "cd", "t", []), ("b", 2, "ef", "t", [(None, "e"), ("f", "f")]), ("b", 3, "gh", "s", []), ("c", 0, "x", "s", [("zz", None)]), ("c", 1, "y", "t", [])]
    df = spark.createDataFrame(rows, "book string, pos int, text string, section string, marks array<struct<start: string, end: string>>")
    got = scenes.rebuild_scenes(df, ["book"], "pos", "section", "marks").collect()
    assert sorted((r["scene"], r["position"], r["span_start"], r["span_end"]) for r in got if r["book"] == "b") == [(0, 0, 0, 2), (1, 1, 0, 2), (1, 2, 0, 1), (2, 2, 1, 2), (3, 3, 0, 2)]
    assert [(r["scene"], r["error"] is not None) for r in got if r["book"] == "c"] == [(None, True)]


def test_lines_are_located_by_clauses():
    text = "雨停了。他说：走吧，我们回家！她没有动。走吧。"
    assert A.locate_line(text, "我们", 0) == (100.0, 10, 15) and text[10:15] == "我们回家！"
    assert A.locate_line(text, "走吧", 8)[1:] == (20, 23)  # never left of the cursor
    assert A.locate_line(text, "*(她没有动)*", 0)[1:] == (15, 20)
    assert A.locate_line("one line\nnext", "line", 0)[1:] == (0, 8)  # a line end stays outside
    score, start, end = A.locate_line(text, "我们回家了", 0)
    assert 80 <= score < 100 and "我们回家" in text[start:end]
    assert A.locate_line(text, "没有的话在这里", 0) is None and A.locate_line(text, "走吧", len(text)) is None
    found = A.locate_lines(text, [("甲", "走吧"), ("Environment", "*(雨停了)*"), ("乙", "没有的话在这里"), ("乙", "走吧"), ("乙", "雨停了")])
    assert [f and f[1:] for f in found] == [(7, 10), None, None, (20, 23), None]


def brute_score(anchors, text):
    at, out = 0, []
    for a, target in anchors:
        if a in text[at:]:
            at = at + text[at:].index(a) + len(a)
            out.append((a, target))
    return sum(len(a) + (10 if t else 0) for a, t in out), len(out)


def test_scenes_are_scored_in_order(spark):
    import random

    rng = random.Random(5)
    words = ["alpha", "beta0", "gammarays", "delta", "epsilonandmore", "zeta"]
    texts = {p: "".join(rng.choice(words) for _ in range(8)) for p in range(12)}
    records = {r: [(rng.choice(words), rng.random() < 0.5) for _ in range(4)] for r in range(20)}
    anchors = spark.createDataFrame([("b", r, k, a, t) for r, items in records.items() for k, (a, t) in enumerate(items)], "book string, rec int, k int, anchor string, target boolean")
    plots = spark.createDataFrame([("b", p, t) for p, t in texts.items()], "book string, plot int, text string")
    got = {(x["rec"], x["plot"]): (x["score"], x["anchors"]) for x in A.score_scenes(anchors, plots, ["book"], "rec", ["k"], "plot").collect()}
    for r, items in records.items():
        for p, t in texts.items():
            if sum(a in t for a, _ in items) >= 2:
                assert got[r, p] == brute_score(items, t)
    assert A.score_scenes(anchors.limit(0), plots, ["book"], "rec", ["k"], "plot").count() == 0


def test_union_of_shared_keys_fails(spark):
    from inkloom.operators import records as K

    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert [r["k"] for r in K.overlap(a, b, ["k"]).collect()] == [1]
    with pytest.raises(Exception, match="both sides"):
        K.keyed_union(a, b, ["k"]).collect()
    assert sorted((r["k"], r["side"]) for r in K.keyed_union(a, b.filter("k = 2"), ["k"]).collect()) == [(1, "old"), (2, "new")]


def test_equal_deletions(spark):
    from inkloom.operators import ranking as R

    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(99, None)], "k int, s string")
    got = R.equal_deletions(rows, "s", ["k"], "k", ["a", "b"], 26, 7).orderBy("place").collect()
    kinds = [r["s"] for r in got]
    assert (kinds.count("a"), kinds.count("b"), kinds.count("c"), kinds.count(None)) == (8, 7, 10, 1)
    assert [r["k"] for r in got] == sorted(r["k"] for r in got) and [r["place"] for r in got] == list(range(1, 27))
    assert R.equal_deletions(rows, "s", ["k"], "k", ["a", "b"], 31, 7).count() == 31
    for target in (0, 32, 30, 5):
        with pytest.raises(ValueError):
            R.equal_deletions(rows, "s", ["k"], "k", ["a", "b"], target, 7)


def test_profile_files(spark, tmp_path):
    names = sinks.write_profiles(spark.createDataFrame([("B/x", "two\nlines"), ("A", "one"), ("  ", "three")], "name string, profile string"), str(tmp_path / "p"))
    assert names == ["0001-character.txt", "0002-A.txt", "0003-B_x.txt"]
    assert (tmp_path / "p" / "0003-B_x.txt").read_text() == "two\nlines\n"


# -- files, models, streams --------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿甲".encode())
    (tmp_path / "b.txt").write_bytes("乙".encode("gb18030"))
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "甲"
    assert sorted(r["text"] for r in files.read_texts_any(spark, str(tmp_path / "*.txt")).collect()) == ["乙", "甲"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    assert files.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert sinks.write_checked(spark.createDataFrame([(1,), (2,)], "k int"), str(tmp_path / "out"), "k") == 2
    assert sinks.free_folder(spark, str(tmp_path), "out").endswith("out-2")
    with pytest.raises(ValueError):
        sinks.free_folder(spark, str(tmp_path), "../x")
    assert files.load_prompt("sys\n----------\nuser") == ("sys", "user")


def test_images_in_natural_order(spark, tmp_path):
    for name in ("c/2.png", "c/10.png", "b/1.jpg", ".h/1.png", "c/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = files.list_images(spark, str(tmp_path)).collect()
    kept = sorted((r["page_index"], r["path"].rsplit("/", 2)[-2:]) for r in rows if r["reason"] is None)
    assert [k[1] for k in kept] == [["b", "1.jpg"], ["c", "2.png"], ["c", "10.png"]]
    assert sorted(r["reason"] for r in rows if r["reason"]) == ["not an image"]  # hidden files are never listed
    pages = spark.createDataFrame([(0, "b"), (1, "c"), (2, "c"), (3, "c")], "page_index int, directory string")
    assert [r["batch_index"] for r in files.page_batches(pages, 2).orderBy("page_index").collect()] == [0, 1, 1, 2]


def test_epub_order(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", '<img src="i/1.png"/><img src="i/2.png"/>')
        z.writestr("o/b.html", '<img src="i/2.png"/>')
        z.writestr("o/i/1.png", "x")
        z.writestr("o/i/2.png", "x")
    (tmp_path / "a.epub").write_bytes(raw.getvalue())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    rows = files.epub_images(spark, str(tmp_path / "*.epub")).collect()
    assert [r["image"] for r in sorted((r for r in rows if r["image"]), key=lambda r: r["page_index"])] == ["o/i/2.png", "o/i/1.png"]
    assert sum(r["error"] is not None for r in rows) == 1


def test_model_stage(spark):
    units = spark.createDataFrame([(1, "q")], "i int, request string").coalesce(1)

    def validate(x):
        if "a" not in x:
            raise ValueError("no a")
        return x

    row = model_stage.run_stage(units, "request", model_stage.scripted(["nothing", '{"b": 1}', '```json\n{"a": 1,}\n```']), validate).first()
    assert (row["result"], row["error"], row["attempts"]) == ('{"a":1}', None, 3)
    failed = model_stage.run_stage(units, "request", model_stage.scripted(["x", "y"]), validate, attempts=2)
    assert failed.first()["result"] is None
    with pytest.raises(RuntimeError):
        model_stage.raise_failures(failed)


def test_chat_export(spark, tmp_path):
    rows = [(1, "Anna/B", 0, "user", "hi", None), (1, "Anna/B", 1, "assistant", "yes", True)]
    sinks.write_chat(spark.createDataFrame(rows, "c int, target string, turn int, role string, content string, loss boolean"), str(tmp_path / "e"), ["c"])
    lines = [json.loads(x) for f in (tmp_path / "e/all").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes", "loss": True}]}]
    assert (tmp_path / "e/by_character/character=Anna_B").exists()


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    events = [(k, base + dt.timedelta(seconds=i), "click" if i % 3 else "buy", float(i)) for i in range(12) for k in (1, 2)]
    schema = "user_id bigint, ts timestamp, event_type string, value double"
    first, second = events[:10], events[10:]
    source = tmp_path / "in"
    for n, part in enumerate((first, second)):
        pd.DataFrame(part, columns=["user_id", "ts", "event_type", "value"]).assign(ts=lambda d: d.ts.dt.strftime("%Y-%m-%dT%H:%M:%S.%fZ")).pipe(lambda d: (source.mkdir(exist_ok=True), d.to_json(source / f"{n}.json", orient="records", lines=True)))
        stream = carry.carried_stream(carry.new_results(spark, str(source), schema), "user_id", "ts", "event_type", "value", ["click", "buy"])
        carry.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.schema("user_id bigint, ts timestamp, event_type string, value double, carried_click double, carried_buy double").json(str(tmp_path / "out"))
    want = S.carried(spark.createDataFrame(events, schema), ["user_id"], ["ts"], "event_type", "value", ["click", "buy"])
    key = lambda df: sorted(map(str, df.select("user_id", "value", "carried_click", "carried_buy").collect()))
    assert key(got) == key(want)
