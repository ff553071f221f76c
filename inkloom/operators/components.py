"""Connected components by alternating large-star and small-star joins.

Every round is two aggregations to the least neighbour, with partial sums
before the shuffle, and one join back; no group is ever gathered, so a node
with a third of all links is no more than a skewed join key.  Rounds are cut
into written tables and end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import cut, drop_cut

#: Rounds after which something must be wrong; the number needed grows as the logarithm of the nodes.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b", merge: bool = False) -> DataFrame:
    """``node, component``: of every node of a link the least node of its component.

    Nodes may be of any type with an order.  Links with a null end and links
    of a node to itself join nothing, but such a node is its own component;
    repeated links count once.  With ``merge`` no side of a join is sent to
    the driver, whatever its estimated size.
    """
    raw = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    alone = raw.filter(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))).select(F.coalesce("a", "b").alias("node")).filter("node is not null").distinct()
    edges = cut(raw.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    alone = cut(alone, "alone")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        after = cut(_small_star(_large_star(edges, merge), merge), "stars")
        drop_cut(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # Now each node has one link, to the least of its component.
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    left = alone.join(_hinted(found, merge), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(left)


def _hinted(side: DataFrame, merge: bool) -> DataFrame:
    return side.hint("merge") if merge else side


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, merge: bool) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.filter("v > u").join(_hinted(least, merge), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame, merge: bool) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.join(_hinted(least, merge), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
