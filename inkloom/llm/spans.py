"""Problem 10: long exact spans shared between records, by seed and extend.

Seeds are winnowed anchors: of every ``threshold - K + 1`` successive hashes of
K code points the least is kept, so any shared span of ``threshold`` code
points holds an anchor in both texts.  Only anchors of two or more texts are
followed.  They are joined with their surroundings, just long enough to hold
any span of the threshold around the anchor, and extended both ways.

An anchor with more than ``HOT`` occurrences isn't paired.  Its surroundings
are cut into all spans of exactly the threshold, so that only texts which share
such a span meet; a span is followed only where the set of texts that hold it
differs from the set of the span one code point before.

Equal texts are one text until the end.  Spans are compared by two independent
64-bit hashes in the hot way, code point by code point in the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.llm.bpe import chunks
from inkloom.session import cut, table

#: Occurrences beyond which an anchor takes the hot way.
HOT = 64
#: What sets the second hash of a span apart from the first.
CHECK_SEED = 0x5851F42D
_U = np.uint64
_MULTIPLY, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _MIX
    return x ^ (x >> _U(32))


def gram_hashes(cp: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of k code points, by doubling."""
    level, size = _scramble((cp.astype(_U) + _U(seed)) * _MULTIPLY), 1
    out, done, n = None, 0, len(cp) - k + 1
    rest = k
    while True:
        if rest & 1:
            piece = level[done : done + n]
            out = piece.copy() if out is None else _scramble(out * _MULTIPLY + piece)
            done += size
        rest >>= 1
        if not rest:
            return out
        level = _scramble(level[:-size] * _MULTIPLY + level[size:])
        size *= 2


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each w successive ones, the last of equals; of a run of equal hashes its ends and every w-th."""
    if len(h) < w:
        w = len(h)
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at = np.where(h[b] <= h[a], b, a)
        size *= 2
    if size < w:
        a, b = at[: len(at) - (w - size)], at[w - size :]
        at = np.where(h[b] <= h[a], b, a)
    at = np.unique(at)
    # Runs of equal hashes come from repeated characters; each selected one is marked at its ends and every w places.
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    if len(begin) == len(h):
        return at
    end = np.append(begin[1:], len(h)) - 1
    run = np.searchsorted(begin, at, "right") - 1
    long = np.unique(run[end[run] > begin[run]])
    marks = [np.append(np.arange(begin[r], end[r], w), end[r]) for r in long]
    return np.unique(np.concatenate([at[end[run] == begin[run]], *marks])) if len(long) else at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _anchors(k: int, threshold: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                which, hashes, places = [], [], []
                cp = _codes("".join(texts[a:b]))
                h = gram_hashes(cp, k)
                begin = 0
                for i in range(a, b):
                    n = len(texts[i])
                    own = h[begin : begin + n - k + 1]
                    at = winnow(own, threshold - k + 1)
                    which.append(np.full(len(at), i, np.int64))
                    hashes.append(own[at])
                    places.append(at)
                    begin += n
                rows = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), ids.take(rows), pa.array(np.concatenate(places).astype(np.int32))], ["anchor", "doc_id", "pos"])

    return run


def _contexts(k: int, threshold: int):
    """Cut the surroundings of each anchor out of its text: threshold - k + 1 before, as much after."""
    side = threshold - k + 1

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for x in found:
                    p = x["pos"]
                    first = max(0, p - side)
                    for column, value in zip(out, (x["anchor"], x["n"], doc, p, p - first, text[first : p + k + side])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.string())], ["anchor", "n", "doc_id", "pos", "at", "near"])

    return run


def _aligned(texts: list[str], at: np.ndarray, side: int, width: int, filler: int) -> np.ndarray:
    """Code points in rows of equal width with the anchors in one column."""
    out = np.full((len(texts), width), filler, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(side - at, size)
    out[row, col] = _codes("".join(texts))
    return out


def _extend(k: int, threshold: int):
    """Extend pairs of anchors both ways; keep those that reach the threshold."""
    side = threshold - k + 1
    width = 2 * side + k
    names = ["doc_id_a", "doc_id_b", "start_a", "end_a", "start_b", "end_b", "first"]

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                a, b, pa_, pb, at_a, at_b = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5))
                x = _aligned(batch.column(6).to_pylist(), at_a, side, width, -1)
                y = _aligned(batch.column(7).to_pylist(), at_b, side, width, -2)
                same = x == y
                left = np.where(same[:, :side].all(1), side, np.argmin(same[:, :side][:, ::-1], 1))
                right = np.where(same[:, side + k :].all(1), side, np.argmin(same[:, side + k :], 1))
                good = same[:, side : side + k].all(1) & (left + k + right >= threshold)
                # The first anchor of a shared span shows its start; in repeated characters any anchor counts.
                first = (left < side) | (x[:, side : side + k] == x[:, side : side + 1]).all(1)
                left, right, a, b, p, q = (v[good].astype(np.int64) for v in (left, right, a, b, pa_, pb))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(p - left), pa.array(p + k + right), pa.array(q - left), pa.array(q + k + right), pa.array(first[good])], names)

    return run


def _windows(k: int, threshold: int):
    """All spans of the threshold in the surroundings of hot anchors."""

    def run(batches):
        for batch in batches:
            docs, pos, at = (batch.column(i).to_numpy() for i in (0, 1, 2))
            hashes, checks, which, starts = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                if len(text) >= threshold:
                    cp = _codes(text)
                    h, other = gram_hashes(cp, threshold), gram_hashes(cp, threshold, CHECK_SEED)
                    # Only spans that hold the whole anchor.
                    low, high = max(0, int(at[i]) + k - threshold), min(len(h) - 1, int(at[i]))
                    hashes.append(h[low : high + 1])
                    checks.append(other[low : high + 1])
                    which.append(np.full(high + 1 - low, i, np.int64))
                    starts.append(np.arange(low, high + 1) + int(pos[i]) - int(at[i]))
            if hashes:
                w = np.concatenate(which)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(checks).view(np.int64)), pa.array(docs[w]), pa.array(np.concatenate(starts).astype(np.int64))], ["span", "check", "doc_id", "start"])

    return run


class SharedSpans:
    """The shared spans of a table of ``doc_id, text``.

    Texts that are null, empty or shorter than the threshold share nothing.
    Ids are unique; a null id is left out.  Ties don't arise: all spans count.
    """

    def __init__(self, docs: DataFrame, threshold: int, hot: int = HOT):
        if threshold < 8:
            raise ValueError("the threshold must be at least 8 code points")
        self.threshold, self.k = threshold, threshold // 2
        k = self.k
        long = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter((F.length("text") >= threshold) & F.col("doc_id").isNotNull())
        # Equal texts: all but the least id stand back.
        digest = F.md5("text")
        classes = long.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
        members = long.select("doc_id", digest.alias("digest")).join(classes, "digest").select("doc_id", "rep")
        self.members = cut(members, "copies")
        copies = self.members.filter("doc_id <> rep").select("doc_id")
        anchors = cut(long.mapInArrow(_anchors(k, threshold), "anchor bigint, doc_id bigint, pos int"), "anchors").join(copies, "doc_id", "left_anti")
        shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("anchor", "n")
        per_doc = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "n", "pos")).alias("found"))
        near = long.join(per_doc, "doc_id").select("doc_id", "text", "found").mapInArrow(_contexts(k, threshold), "anchor bigint, n bigint, doc_id bigint, pos int, at int, near string")
        self.near = cut(near, "near")
        self.runs = self._runs(self.near.filter(F.col("n") <= hot))
        self.spans = self._hot_spans(self.near.filter(F.col("n") > hot))

    def _runs(self, near: DataFrame) -> DataFrame:
        a, b = near.alias("a"), near.alias("b")
        pairs = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.doc_id") < F.col("b.doc_id")))
        pairs = pairs.selectExpr("a.doc_id doc_id_a", "b.doc_id doc_id_b", "a.pos pos_a", "b.pos pos_b", "a.at at_a", "b.at at_b", "a.near near_a", "b.near near_b")
        return pairs.mapInArrow(_extend(self.k, self.threshold), "doc_id_a bigint, doc_id_b bigint, start_a bigint, end_a bigint, start_b bigint, end_b bigint, first boolean")

    def _hot_spans(self, near: DataFrame) -> DataFrame:
        """``span, doc_id, start`` of the spans that two or more texts hold, and whether the set of their texts is new."""
        spans = near.select("doc_id", "pos", "at", "near").mapInArrow(_windows(self.k, self.threshold), "span bigint, check bigint, doc_id bigint, start bigint").distinct()
        sets = spans.select("span", "check", "doc_id").distinct().groupBy("span", "check").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark")).filter("n > 1")
        marked = spans.join(sets, ["span", "check"])
        order = W.partitionBy("doc_id").orderBy("start")
        before = F.struct(F.lag("start").over(order).alias("s"), F.lag("n").over(order).alias("n"), F.lag("mark").over(order).alias("m"))
        return marked.withColumn("before", before).withColumn("new", ~F.coalesce((F.col("before.s") == F.col("start") - 1) & (F.col("before.n") == F.col("n")) & (F.col("before.m") == F.col("mark")), F.lit(False))).drop("before", "n", "mark")

    def pairs(self) -> DataFrame:
        """``doc_id_a, doc_id_b``, a < b, each pair once."""
        direct = self.runs.filter("first").select("doc_id_a", "doc_id_b")
        # Where the set of texts is new in any of them, the span is followed in all.
        news = self.spans.filter("new").select("span", "check").distinct()
        held = self.spans.select("span", "check", "doc_id").distinct().join(news, ["span", "check"], "left_semi")
        x, y = held.alias("x"), held.alias("y")
        hot = x.join(y, (F.col("x.span") == F.col("y.span")) & (F.col("x.check") == F.col("y.check")) & (F.col("x.doc_id") < F.col("y.doc_id"))).selectExpr("x.doc_id doc_id_a", "y.doc_id doc_id_b")
        reps = direct.unionByName(hot).distinct()
        m = self.members
        wide = reps.join(m.selectExpr("rep doc_id_a", "doc_id a"), "doc_id_a", "left").join(m.selectExpr("rep doc_id_b", "doc_id b"), "doc_id_b", "left")
        wide = wide.select(F.coalesce("a", "doc_id_a").alias("a"), F.coalesce("b", "doc_id_b").alias("b"))
        between = wide.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        x, y = m.alias("x"), m.alias("y")
        within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.doc_id") < F.col("y.doc_id"))).selectExpr("x.doc_id doc_id_a", "y.doc_id doc_id_b")
        return between.unionByName(within)

    def shares(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_chars, shared_chars, shared_share`` of every row; a null text has 0 code points."""
        t = self.threshold
        parts = self.runs.selectExpr("doc_id_a doc_id", "start_a s", "end_a e").unionByName(self.runs.selectExpr("doc_id_b doc_id", "start_b s", "end_b e"))
        parts = parts.unionByName(self.spans.select("doc_id", F.col("start").alias("s"), (F.col("start") + t).alias("e"))).groupBy("doc_id", "s").agg(F.max("e").alias("e"))
        order = W.partitionBy("doc_id").orderBy("s")
        reach = F.coalesce(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        union = parts.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", reach))).groupBy("doc_id").agg(F.sum("new").alias("part"))
        sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
        out = sized.join(union, "doc_id", "left").join(self.members.select("doc_id", F.lit(True).alias("copy")), "doc_id", "left")
        shared = F.when(F.col("copy"), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("bigint")
        return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars").cast("double")), F.lit(0.0)).alias("shared_share"))


def _threshold(spark, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "size_limits").filter("setting_name = 'shared_span_chars'").first()["setting_value"])


def p10_found(spark, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents"), _threshold(spark, sf_dir)).pairs()


def p10_shared(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return SharedSpans(docs, _threshold(spark, sf_dir)).shares(docs)
