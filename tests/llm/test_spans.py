import random

import numpy as np
import pytest

from inkloom.llm.spans import SharedSpans, gram_hashes, winnow


def brute(texts, t):
    grams = {i: {x[j : j + t] for j in range(len(x) - t + 1)} for i, x in texts.items() if x}
    ids = sorted(grams)
    return {(a, b) for a in ids for b in ids if a < b and grams[a] & grams[b]}


def corpus(seed, n=60, t=16):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcd é中🙂") for _ in range(k))
    shared = [word(k) for k in (t - 1, t, t + 3, 3 * t, 5 * t)]
    texts = {}
    for i in range(n):
        parts = [word(rng.randint(0, 2 * t))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 2) :], word(rng.randint(0, t))]
        texts[i] = "".join(parts)
    texts |= {100: None, 101: "", 102: "x" * 100, 103: "x" * 40, 104: texts[5], 105: texts[5], 106: "ab" * 30, 107: "ba" * 30}
    return texts


@pytest.mark.parametrize("hot", [1000, 3, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_shares_as_by_brute_force(spark, seed, hot):
    texts, t = corpus(seed), 16
    df = spark.createDataFrame([(i, x, "y") for i, x in texts.items()], "doc_id bigint, text string, pos string")
    work = SharedSpans(df, t, hot=hot)
    rows = work.pairs().collect()
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in rows}
    assert len(rows) == len(got)
    assert got == brute(texts, t)
    shares = {r["doc_id"]: r["shared_chars"] for r in work.shares(df).collect()}
    assert set(shares) == set(texts)
    for i, x in texts.items():
        covered = set()
        if x:
            others = {y[j : j + t] for k, y in texts.items() if k != i and y for j in range(len(y) - t + 1)}
            for j in range(len(x) - t + 1):
                if x[j : j + t] in others:
                    covered.update(range(j, j + t))
        assert shares[i] == len(covered), i


def test_every_window_has_an_anchor():
    h = gram_hashes(np.frombuffer("the quick brown fox jumps over it".encode("utf-32-le"), "<u4"), 5)
    at = set(winnow(h, 4).tolist())
    assert all(at & set(range(i, i + 4)) for i in range(len(h) - 3))


def test_empty_table(spark):
    work = SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), 16)
    assert work.pairs().collect() == []


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), 4)
