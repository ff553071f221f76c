import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.packing import pack, sum_of_squares


def brute(sizes, capacity):
    levels, out = [], []
    for s in sizes:
        best = None
        for b, level in [*enumerate(levels), (len(levels), 0)]:
            if level + s > capacity:
                continue
            after = [*levels]
            if b == len(after):
                after.append(0)
            after[b] += s
            counts = {}
            for x in after:
                if 0 < x < capacity:
                    counts[x] = counts.get(x, 0) + 1
            cost = sum(c * c for c in counts.values())
            key = (cost, -level)
            if best is None or key < best[0]:
                best = (key, level)
        level = best[1]
        out.append(level)
        if level == 0:
            levels.append(s)
        else:
            levels[levels.index(level)] += s
    return sorted(levels)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_levels_as_by_definition(sizes):
    box = sum_of_squares(np.array(sizes, np.int64), 12)
    got = sorted(np.bincount(box, weights=sizes).astype(int).tolist()) if sizes else []
    assert got == brute(sizes, 12)


def test_all_items_fit_and_none_is_cut_without_need(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(3000)] + [(9001, 250), (9002, 100), (9003, 0), (9004, None), (9001, 250)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 100, shard_items=500).toPandas()
    assert got.groupby("container_id").tokens.sum().max() <= 100
    assert not {9003, 9004} & set(got.doc_id)
    want = {i: n for i, n in rows if n}
    assert got.groupby("doc_id").tokens.sum().to_dict() == want
    pieces = got.groupby("doc_id").size()
    assert (pieces.drop([9001]) == 1).all() and pieces[9001] == 3
    assert sorted(got[got.doc_id == 9001].piece_start) == [0, 100, 200]
    assert got.container_id.nunique() <= 1.05 * sum(want.values()) / 100


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 10).collect() == []
