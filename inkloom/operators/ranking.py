"""Numbering, sampling and paging without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from inkloom.session import cut


def global_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 1 in the given order.

    A window without partitions would be one task; here the rows are range
    partitioned and sorted, each partition numbers its own, and the partitions'
    sizes, one row each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "_part", "_at"])
            at += n

    schema = ST.StructType([*df.schema.fields, ST.StructField("_part", ST.IntegerType()), ST.StructField("_at", ST.LongType())])
    local = cut(rows.mapInArrow(number, schema), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition.
    offsets = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def seeded(key: str, seed: int):
    """A shuffle key: the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def tiered_sample(df: DataFrame, groups: Sequence[str], tier: str, key: str, share: float, seed: int) -> DataFrame:
    """A share of each group, rounded half up, at least one row: tiers in order, each shuffled."""
    w = W.partitionBy(*groups)
    hashed = df.withColumn("_h", seeded(key, seed))
    placed = hashed.withColumn("place", F.row_number().over(w.orderBy(tier, "_h"))).withColumn("_n", F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(share) + F.lit(0.5))))
    return placed.filter(F.col("place") <= F.col("_n")).drop("_n", "_h")


def balanced(df: DataFrame, groups: Sequence[str], key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, chosen by a seeded hash, which stays in ``_h``."""
    hashed = df.withColumn("_h", seeded(key, seed))
    return hashed.withColumn("_rn", F.row_number().over(W.partitionBy(*groups).orderBy("_h", key))).filter(F.col("_rn") <= most).drop("_rn")


def equal_deletions(df: DataFrame, source: str, order: Sequence[str], key: str, shrunk: Sequence[str], target: int, seed: int) -> DataFrame:
    """``target`` rows, from two sources of which rows are left out in equal numbers (the second gives up the odd one); with ``place`` in the order of all rows.

    The rows left out are drawn by a seeded hash.  A target that can't be
    reached this way raises: more rows than there are, a source without rows,
    only one row to leave out, or all of a source.
    """
    first, second = shrunk
    if target < 1:
        raise ValueError("the target must be at least 1")
    counts = df.agg(F.count("*").alias("all"), F.count_if(F.col(source) == first).alias("a"), F.count_if(F.col(source) == second).alias("b")).first()
    surplus = counts["all"] - target
    if surplus < 0:
        raise ValueError(f"only {counts['all']} rows for {target}")
    gone = {first: surplus // 2, second: surplus - surplus // 2}
    if surplus and not all(0 < gone[s] < counts[c] for s, c in ((first, "a"), (second, "b"))):
        raise ValueError(f"{surplus} rows can't be left out of {counts['a']} and {counts['b']} in equal parts")
    least = F.lit(0)
    for name, n in gone.items():
        least = F.when(F.col(source) == name, F.lit(n)).otherwise(least)
    drawn = F.row_number().over(W.partitionBy(source).orderBy(seeded(key, seed), key))
    special = df.filter(F.col(source).isin(first, second)).withColumn("_drawn", drawn).filter(F.col("_drawn") > least).drop("_drawn")
    rest = df.filter(~F.coalesce(F.col(source).isin(first, second), F.lit(False)))
    return global_row_number(rest.unionByName(special), order, "place")


def newest_page(df: DataFrame, groups: Sequence[str], key: str, size: int) -> DataFrame:
    """The newest rows of each group, oldest first, with ``place``, ``has_more`` and ``next_before``, the id before which the next page lies."""
    w = W.partitionBy(*groups)
    placed = df.withColumns({"_back": F.row_number().over(w.orderBy(F.desc(key))), "_n": F.count("*").over(w)}).filter(F.col("_back") <= size)
    return placed.withColumns({"place": F.least(F.col("_n"), F.lit(size)) - F.col("_back"), "has_more": F.col("_n") > size, "next_before": F.min(key).over(w)}).drop("_back", "_n")


def spine_sample(df: DataFrame, groups: Sequence[str], order: str, first: int = 3, middle: int = 4, last: int = 3) -> DataFrame:
    """The first, middle and last rows of each group, each row once."""
    w = W.partitionBy(*groups)
    placed = df.withColumns({"_p": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    begin = F.expr(f"(_n - {middle}) div 2")
    return placed.filter((F.col("_p") < first) | (F.col("_p") >= F.col("_n") - last) | ((F.col("_p") >= begin) & (F.col("_p") < begin + middle))).drop("_p", "_n")
