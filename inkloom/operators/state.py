"""Timelines of state changes, and the state at a place in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_asof(messages: DataFrame, events: DataFrame, keys: Sequence[str], at: str, name: str, value: str, message_key: str) -> DataFrame:
    """``keys, message_key, at, name, value``: of each message, the latest value of every state at or before its place.

    Events and messages are merged and sorted once per group; each state's
    value is carried along, so the work is linear and no pairs are made.
    """
    names = events.select(*keys, name).distinct()
    asked = messages.select(*keys, message_key, at).join(names, list(keys)).select(*keys, name, at, F.lit(1).alias("_kind"), F.col(message_key).alias("_m"), F.lit(None).cast(events.schema[value].dataType).alias(value))
    told = events.select(*keys, name, at, F.lit(0).alias("_kind"), F.lit(None).cast(messages.schema[message_key].dataType).alias("_m"), value)
    w = W.partitionBy(*keys, name).orderBy(at, "_kind").rowsBetween(W.unboundedPreceding, 0)
    carried = told.unionByName(asked).withColumn("_v", F.last(F.when(F.col("_kind") == 0, F.struct(value)), ignorenulls=True).over(w))
    return carried.filter((F.col("_kind") == 1) & F.col("_v").isNotNull()).select(*keys, F.col("_m").alias(message_key), at, name, F.col("_v")[value].alias(value))


def timeline_issues(events: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, before: str, after: str) -> DataFrame:
    """Add ``issue`` to events: ``no-op`` if nothing changes, ``mismatch`` if the value before isn't the last known one."""
    w = W.partitionBy(*keys, name).orderBy(*order)
    known = F.lag(after).over(w)
    issue = F.when(F.col(before).eqNullSafe(F.col(after)), "no-op").when(known.isNotNull() & ~known.eqNullSafe(F.col(before)), "mismatch")
    return events.withColumn("known", known).withColumn("issue", issue)


def transition_groups(events: DataFrame, keys: Sequence[str], end: str, source: str) -> DataFrame:
    """``keys, end, source, n, related``: changes that end at one place; the longest source, and whether all others end it."""
    grouped = events.groupBy(*keys, end).agg(F.max_by(source, F.struct(F.length(source), source)).alias("outer"), F.count("*").alias("n"), F.collect_set(source).alias("_all"))
    return grouped.withColumn("related", F.forall("_all", lambda s: F.endswith(F.col("outer"), s))).drop("_all")
