import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkloom.llm import bpe
from inkloom.llm.tokens import count_tokens, encode


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ids_of(texts):
    flat, count = bpe.encoder(bpe.DEFAULT_TOKENIZER).encode(texts)
    ends = np.cumsum(count)
    return [flat[e - c : e].tolist() for e, c in zip(ends, count)]


def test_agrees_with_the_library_on_odd_texts(reference):
    texts = ["", " ", "  ", "\n", "it's  'something we'll\n\n x\t y 's '''s  ''re <|endoftext|> don't a'", "　 a​ b", "１２③ Ⅷ", "é ́", "a" * 3000, "一" * 2000, "ab" * 3000, "\x1c\x1d \x85x", "\U0001f468‍\U0001f469", " 'll'll'llx'lly 'vE"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab'sltrevmd \n\t .,1é中の　🙂") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert ids_of(texts) == reference(texts)


def test_batches_don_t_change_the_result():
    texts = ["one two", "", "three's", " four"] * 5
    assert ids_of(texts) == [i for t in texts for i in ids_of([t])]


def test_chunks_cover_all_rows():
    texts = ["x" * n for n in (0, 5, 200, 1, 0, 3)]
    ranges = list(bpe.chunks(texts, 6))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(texts)))
    assert list(bpe.chunks([], 6)) == []


def test_nulls_repeats_and_extra_columns(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "a b", "x"), (4, "a b", "x"), (None, "c", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode(df).collect()), key=str)
    want = sorted(((i, reference([t or ""])[0]) for i, t, _ in rows), key=str)
    assert got == want
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] == 2


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
