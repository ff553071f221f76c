"""Units of work, model records, tasks, profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.operators.relations import pending


def next_jobs(units: DataFrame, results: DataFrame, key: str, result: str, start: int, limit: int) -> DataFrame:
    """The next units from ``start`` on that have no good result: first what is done goes, then the limit counts."""
    return pending(units.filter(F.col(key) >= start), results, [key], result).orderBy(key).limit(limit)


def job_places(units: DataFrame, results: DataFrame, groups: Sequence[str], order: str, result: str) -> DataFrame:
    """Add ``place``: the units of each group that are still to do, numbered from 1 in order."""
    todo = pending(units, results, [*groups, order], result)
    return todo.withColumn("place", F.row_number().over(W.partitionBy(*groups).orderBy(order)))


def zip_lines(mapping: DataFrame, predictions: DataFrame, line: str, expected: str, given: str) -> DataFrame:
    """Mapping and predictions by line, with ``problem``: a line that one side lacks, or labels that differ."""
    a, b = mapping.withColumn("_a", F.lit(True)), predictions.withColumn("_b", F.lit(True))
    problem = F.when(F.col("_b").isNull(), "no prediction").when(F.col("_a").isNull(), "no mapping").when(~F.col(expected).eqNullSafe(F.col(given)), "other label")
    return a.join(b, line, "full_outer").withColumn("problem", problem).drop("_a", "_b")


def task_problems(tasks: DataFrame, groups: Sequence[str], name: str, values: str, known: DataFrame) -> DataFrame:
    """Add ``problem`` to tasks: an unknown name, a name that occurs twice, no values, an empty or a repeated value."""
    counted = tasks.withColumn("_n", F.count("*").over(W.partitionBy(*groups, name)))
    names = known.select(*groups, F.col(name)).distinct().withColumn("_k", F.lit(True))
    problem = (
        F.when(F.col("_k").isNull(), "unknown name")
        .when(F.col("_n") > 1, "name twice")
        .when(F.coalesce(F.size(values), F.lit(0)) <= 0, "no values")
        .when(F.exists(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), "empty value")
        .when(F.size(F.array_distinct(values)) < F.size(values), "value twice")
    )
    return counted.join(names, [*groups, name], "left").withColumn("problem", problem).drop("_n", "_k")


def profiles_by_alias(groups: DataFrame, profiles: DataFrame, keys: Sequence[str], group: str, names: str, name: str, profile: str) -> DataFrame:
    """``keys, group, profile, conflict``: the profile that any name of a group finds; null if different ones are found."""
    each = groups.select(*keys, group, F.explode(F.array_distinct(names)).alias(name))
    found = each.join(profiles, [*keys, name]).groupBy(*keys, group).agg(F.count_distinct(profile).alias("_n"), F.min(profile).alias("_p"))
    return found.select(*keys, group, F.when(F.col("_n") == 1, F.col("_p")).alias(profile), (F.col("_n") > 1).alias("conflict"))


def assigned_names(observations: DataFrame, catalogue: DataFrame, keys: Sequence[str], written: str, name: str, aliases: str) -> DataFrame:
    """Add ``name`` to observations: a catalogue name as written, else the one name of a unique alias, else null."""
    formal = catalogue.select(*keys, F.col(name).alias(written), F.col(name).alias("_formal")).distinct()
    each = catalogue.select(*keys, name, F.explode(aliases).alias(written)).distinct()
    single = each.groupBy(*keys, written).agg(F.count_distinct(name).alias("_n"), F.min(name).alias("_alias")).filter("_n = 1").drop("_n")
    return observations.join(formal, [*keys, written], "left").join(single, [*keys, written], "left").withColumn(name, F.coalesce("_formal", "_alias")).drop("_formal", "_alias")


def descriptions_by_name(observations: DataFrame, keys: Sequence[str], name: str, order: str, description: str) -> DataFrame:
    """``keys, name, description``: different descriptions of a name in first-seen order, one a line."""
    first = observations.filter(F.coalesce(F.trim(description), F.lit("")) != "").groupBy(*keys, name, description).agg(F.min(order).alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", F.col(description).alias("_d"))))
    return first.groupBy(*keys, name).agg(F.array_join(F.transform(ordered, lambda x: x["_d"]), "\n").alias(description))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, changed``: which fields of a record differ, in order; records on one side only are left out."""
    b = after.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    flags = [F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]
    return before.join(b, key).select(key, F.array_compact(F.array(*flags)).alias("changed"))


def unique_refs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], refs: str) -> DataFrame:
    """``keys, refs``: all references of a group, each once, in first-seen order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(refs).alias("_r"))))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.filter(F.transform(ordered, lambda x: x["_r"]), lambda r: r.isNotNull()))).alias(refs))


def overlap(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, each once, that both sides hold."""
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), list(keys), "left_semi")


def keyed_union(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides, with ``side``; a key that both hold raises when the rows are read, so that none is lost unseen."""
    shared = old.select(*keys).distinct().withColumn("_shared", F.lit(True))
    key = F.to_json(F.struct(*keys))
    side = F.when(F.col("_shared"), F.raise_error(F.concat(F.lit("the key is on both sides: "), key))).otherwise(F.lit("new"))
    fresh = new.select(*old.columns).join(shared, list(keys), "left").withColumn("side", side).select(*old.columns, "side")
    return old.withColumn("side", F.lit("old")).unionByName(fresh)


def budget_groups(rows: DataFrame, keys: Sequence[str], order: str, size: Column, budget: int) -> DataFrame:
    """Add ``pack`` to rows: successive rows whose sizes fit the budget together; a larger row stands alone."""
    from inkloom.operators.chunking import pack_ends

    item = F.struct(F.col(order).alias("o"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n"))
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    ends = pack_ends(F.transform("_i", lambda x: x["n"]), budget, crossing=False)
    each = gathered.withColumn("_e", ends).select(*keys, F.col("_e"), F.posexplode("_i").alias("_p", "_x"))
    return each.select(*keys, F.col("_x.o").alias(order), F.size(F.filter("_e", lambda e: e <= F.col("_p"))).alias("pack"))


def assemble(batches: DataFrame, expected: DataFrame, keys: Sequence[str], chunk: str, order: str) -> DataFrame:
    """Lines of a conversation reindexed from 0 by chunk and place; ``complete`` says whether its chunks are the expected ones."""
    want = expected.select(*keys, chunk).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(chunk)).alias("_want"))
    have = batches.select(*keys, chunk).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(chunk)).alias("_have"))
    whole = have.join(want, list(keys), "left").select(*keys, F.coalesce(F.col("_have") == F.col("_want"), F.lit(False)).alias("complete"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(chunk, order)) - 1
    return batches.withColumn("place", place).join(whole, list(keys))


def visual_problems(lines: DataFrame, batches: DataFrame, characters: DataFrame, batch: str) -> DataFrame:
    """Add ``problem`` to visual lines: a page outside the batch, a speaker that isn't one of its characters or is one twice."""
    known = characters.groupBy(batch, F.col("character_index").alias("speaker")).agg(F.count("*").alias("_n"))
    problem = F.when(~F.coalesce(F.col("page_index").between(F.col("first_page"), F.col("last_page")), F.lit(False)), "page outside").when(F.col("speaker").isNotNull() & F.col("_n").isNull(), "unknown speaker").when(F.col("_n") > 1, "speaker twice")
    return lines.join(batches, batch, "left").join(known, [batch, "speaker"], "left").withColumn("problem", problem).drop("_n", "first_page", "last_page")
