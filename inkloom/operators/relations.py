"""Joins, set operations, coverage and validation between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def strict_zip(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides by key, with ``side``: ``both``, ``left`` or ``right`` where one lacks the other."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, list(keys), "full_outer").withColumn("side", side).drop("_l", "_r")


def canonical(df: DataFrame, aliases: DataFrame, keys: Sequence[str], column: str, alias: str, name: str, order: Sequence[str] = ()) -> DataFrame:
    """Replace aliases by canonical names; an alias of several names takes the last by ``order``, then by name, an unknown one stays."""
    last = aliases.groupBy(*keys, alias).agg(F.max_by(name, F.struct(*order, name)).alias("_name"))
    return df.join(last.withColumnRenamed(alias, column), [*keys, column], "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def span_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, id_a: str, id_b: str) -> DataFrame:
    """``keys, id_a, id_b, start, end``: pairs of half-open spans in one group that overlap, cut to what they share."""
    x = a.select(*keys, id_a, F.col(start).alias("_s1"), F.col(end).alias("_e1"))
    y = b.select(*keys, id_b, F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    shared = x.join(y, list(keys)).filter((F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1")))
    return shared.select(*keys, id_a, id_b, F.greatest("_s1", "_s2").alias("start"), F.least("_e1", "_e2").alias("end"))


def place_of(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, value: str) -> DataFrame:
    """The range that begins last at or before each point: a merge of both sides, no pairs."""
    told = ranges.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_k"), F.struct(value).alias("_v"), F.lit(None).cast("struct<x:boolean>").alias("_none"))
    columns = [c for c in points.columns if c not in keys]
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_k"), F.struct(*columns).alias("_p"))
    both = told.drop("_none").unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).filter("_k = 1")
    return found.select(*keys, *[F.col(f"_p.{c}") for c in columns], F.col(f"_f.{value}").alias(value))


def pending(units: DataFrame, results: DataFrame, keys: Sequence[str], result: str) -> DataFrame:
    """Units without a good result; a null result is a failed one, an empty one is good."""
    good = results.filter(F.col(result).isNotNull()).select(*keys).distinct()
    return units.join(good, list(keys), "left_anti")


def set_report(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, status``: ``missing`` or ``extra`` elements of two sets."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("status", F.lit("extra")))


def coverage(units: DataFrame, covered: DataFrame, group: Sequence[str], unit: str) -> DataFrame:
    """``group, total, covered, coverage``: the share of distinct units that are covered; 1 for none."""
    all_, got = units.select(*group, unit).distinct(), covered.select(*group, unit).distinct().withColumn("_c", F.lit(1))
    both = all_.join(got, [*group, unit], "left").groupBy(*group).agg(F.count("*").alias("total"), F.count("_c").alias("covered"))
    return both.withColumn("coverage", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("total").cast("double")), F.lit(1.0)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n`` of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def best_match(scored: DataFrame, keys: Sequence[str], candidate: str, score: str, least: float, margin: float) -> DataFrame:
    """The best candidate of each key if it reaches ``least`` and the next is more than ``margin`` behind."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), candidate)
    top = scored.withColumns({"_rn": F.row_number().over(w), "_next": F.lead(score).over(w)}).filter("_rn = 1")
    return top.filter((F.col(score) >= least) & (F.col("_next").isNull() | (F.col(score) - F.col("_next") > margin))).drop("_rn", "_next")


def chosen(scored: DataFrame, keys: Sequence[str], candidate: str, least: int = 20, least_anchors: int = 2, least_coverage: float = 0.45, margin: int = 5) -> DataFrame:
    """Of each key the candidate with the best ``score``, then ``coverage``, if it has enough of both and of ``anchors`` and the next lies more than ``margin`` behind."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("coverage"), candidate)
    top = scored.withColumns({"_rn": F.row_number().over(w), "_next": F.lead("score").over(w)}).filter("_rn = 1")
    enough = (F.col("score") >= least) & (F.col("anchors") >= least_anchors) & (F.col("coverage") >= least_coverage)
    return top.filter(enough & (F.col("_next").isNull() | (F.col("score") - F.col("_next") > margin))).drop("_rn", "_next")


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """Add ``broken``: the names of the rules that don't hold, in order; a rule that is null doesn't."""
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))
