"""Problem 2: splits that keep tied records together, by grouped iterative stratification.

Records are tied by scene and by named person; the components of the graph of
scenes and names are the groups.  Each group has a vector of label counts.
Groups are placed by the rarest label still outstanding, into the split that
needs it most.

Groups of at least a ``1 / BIG_PARTS`` part of all records, so at most
``BIG_PARTS`` of them, are placed one after the other on the driver.  The small
ones are placed in shards by hash, each towards the rest of the targets in
proportion to what the shard holds.  All labels count; of each label one total
per split is held on the driver and in each task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators.components import components
from inkloom.operators.ranking import global_row_number
from inkloom.session import cut, table

BIG_PARTS = 1000
#: Groups, and groups times labels, in one shard, about; a shard is one task's work.
SHARD_GROUPS, SHARD_CELLS = 20_000, 20_000_000
#: Scenes are numbered below all names, so that the least node of a group is its least scene.
_BELOW = 1 << 62


def groups(records: DataFrame, key: str, scope: list[str], name: str, nobody: list[str]) -> DataFrame:
    """``key`` and ``group_<scope>`` of each record: the least scene of the group.

    Two records are tied if they share all scope columns, or a name that is
    neither null nor in ``nobody``.  A record with a null in its scope is tied
    by name only; without either it is a group of its own, with nulls.  A
    repeated record gives one row.
    """
    named = F.when(~F.col(name).isin(nobody), F.col(name))
    known = F.lit(True)
    for c in scope:
        known = known & F.col(c).isNotNull()
    rows = records.select(key, *scope, named.alias("_name")).distinct()
    # Nodes are numbers: scenes in their order, then names.
    scenes = cut(global_row_number(rows.filter(known).select(*scope).distinct(), scope, "_n").select(*scope, (F.col("_n") - F.lit(_BELOW)).alias("_scene")), "scenes")
    people = cut(global_row_number(rows.filter(F.col("_name").isNotNull()).select("_name").distinct(), ["_name"], "_person"), "people")
    placed = cut(rows.join(scenes, scope, "left").join(people, "_name", "left").select(key, "_scene", "_person"), "placed")
    tie = placed.filter(F.col("_scene").isNotNull() | F.col("_person").isNotNull()).select(F.col("_scene").alias("a"), F.col("_person").alias("b")).distinct()
    parts = components(tie)
    grouped = placed.withColumn("node", F.coalesce("_scene", "_person")).join(parts, "node", "left")
    first = scenes.select(F.col("_scene").alias("component"), *[F.col(c).alias(f"group_{c}") for c in scope])
    out = grouped.join(first, "component", "left")
    group_id = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("r"), F.col(key).cast("string")))
    return out.select(key, *[f"group_{c}" for c in scope], group_id.alias("group_id")).distinct()


def stratify(vectors: np.ndarray, sizes: np.ndarray, need: np.ndarray, need_size: np.ndarray) -> np.ndarray:
    """The split of each group: by the rarest outstanding label, into the split that needs it most.

    ``vectors`` is groups x labels, ``need`` splits x labels.  Ties go to the
    split that needs more records, then to the earlier one.  Both needs are
    used up in place.
    """
    out = np.full(len(sizes), -1, np.int64)
    left = vectors.sum(0).astype(float)
    waiting = sizes.copy().astype(bool) | True
    while waiting.any():
        open_ = np.flatnonzero(left > 0.5)
        if len(open_):
            label = open_[np.argmin(left[open_])]
            turn = np.flatnonzero(waiting & (vectors[:, label] > 0))
            turn = turn[np.lexsort((turn, -sizes[turn], -vectors[turn, label]))]
        else:
            label, turn = None, np.flatnonzero(waiting)
            turn = turn[np.lexsort((turn, -sizes[turn]))]
        for g in turn.tolist():
            wanted = need_size if label is None else need[:, label]
            best = np.flatnonzero(wanted >= wanted.max() - 1e-9)
            s = int(best[np.argmax(need_size[best])])
            out[g] = s
            need[s] -= vectors[g]
            need_size[s] -= sizes[g]
        left -= vectors[turn].sum(0)
        waiting[turn] = False
        if label is not None:
            left[label] = 0
    return out


def settle(out: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, need: np.ndarray, need_size: np.ndarray) -> np.ndarray:
    """Move single groups between splits while that brings the splits' sizes nearer to their targets."""
    for _ in range(4 * len(out)):
        source = need_size[out]
        gain = 2 * sizes[:, None] * (source[:, None] - need_size[None, :] + sizes[:, None])
        gain[np.arange(len(out)), out] = 0
        g, s = np.unravel_index(np.argmin(gain), gain.shape) if len(out) else (0, 0)
        if not len(out) or gain[g, s] >= -1e-9:
            return out
        was = out[g]
        need[was] += vectors[g]
        need_size[was] += sizes[g]
        need[s] -= vectors[g]
        need_size[s] -= sizes[g]
        out[g] = s
    return out


def assign(grouped: DataFrame, labelled: DataFrame, key: str, targets: dict[str, float]) -> DataFrame:
    """``group_id, split_label`` from ``key, group_id`` and ``key, label``; shares are normalised to 1."""
    total_share = sum(targets.values())
    names = sorted(targets, key=lambda s: (-targets[s], s))
    share = np.array([targets[n] / total_share for n in names])
    rows = grouped.select(key, "group_id")
    held = rows.groupBy("group_id").agg(F.count_distinct(key).cast("double").alias("n"))
    counts = rows.join(labelled, key).groupBy("group_id", "label").agg(F.count("*").cast("double").alias("c"))
    listed = counts.filter("label is not null").groupBy("group_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "c")))).alias("labels"))
    sized = cut(held.join(listed, "group_id", "left"), "sized")
    sums = sized.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.count("*").alias("groups")).first()
    totals = {r["label"]: r["c"] for r in counts.filter("label is not null").groupBy("label").agg(F.sum("c").alias("c")).collect()}  # one row per label
    least_big = max(1.0, sums["n"] / BIG_PARTS)
    big = sized.filter(F.col("n") >= least_big).orderBy("group_id").toPandas()  # at most BIG_PARTS rows
    labels = sorted(totals)

    def matrix(maps, known: list[str]) -> np.ndarray:
        at = {x: i for i, x in enumerate(known)}
        out = np.zeros((len(maps), len(known)))
        for row, m in enumerate(maps):
            for x, c in dict(m or {}).items():
                out[row, at[x]] = c
        return out

    vectors, sizes = matrix(list(big["labels"]), labels), big["n"].to_numpy(float)
    rest, need = share * sums["n"], share[:, None] * np.array([totals[x] for x in labels])[None, :]
    placed = settle(stratify(vectors, sizes, need, rest), vectors, sizes, need, rest)
    need, rest = np.maximum(need, 0), np.maximum(rest, 0)
    of_label = {x: need[:, i] / need[:, i].sum() if need[:, i].sum() > 0 else share for i, x in enumerate(labels)}
    of_size = rest / rest.sum() if rest.sum() > 0 else share
    shards = max(1, math.ceil(sums["groups"] / SHARD_GROUPS), math.ceil(sums["groups"] * len(labels) / SHARD_CELLS))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        known = sorted({x for m in pdf["labels"] for x in dict(m or {})})
        v, n = matrix(list(pdf["labels"]), known), pdf["n"].to_numpy(float)
        own = np.stack([of_label[x] for x in known], 1) * v.sum(0)[None, :] if known else np.zeros((len(share), 0))
        got = stratify(v, n, own, of_size * n.sum())
        return pd.DataFrame({"group_id": pdf["group_id"].to_numpy(), "split_label": [names[i] for i in got]})

    small = sized.filter(F.col("n") < least_big).withColumn("shard", F.pmod(F.xxhash64("group_id"), F.lit(shards)))
    small = small.groupBy("shard").applyInPandas(place, "group_id string, split_label string")
    if not len(big):
        return small
    spark = sized.sparkSession
    return small.unionByName(spark.createDataFrame(list(zip(big["group_id"], [names[i] for i in placed])), "group_id string, split_label string"))


def _labels(candidates: DataFrame) -> DataFrame:
    """The labels to balance: length of the conversation, checks, whether a system message is there."""
    turns: Column = F.concat(F.lit("turns-"), F.least(F.floor(F.coalesce(F.size("messages"), F.lit(0)) / 3), F.lit(3)).cast("string"))
    checks = F.concat(F.lit("checks-"), F.least(F.greatest(F.coalesce(F.size("validations"), F.lit(0)), F.lit(0)), F.lit(3)).cast("string"))
    system = F.concat(F.lit("system-"), F.coalesce(F.exists("messages", lambda m: m["role"] == "system"), F.lit(False)).cast("string"))
    return candidates.select("candidate_id", F.explode(F.array(turns, checks, system)).alias("label")).distinct()


def _grouped(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "candidates"), "candidate_id", ["book_key", "plot_index"], "character_name", ["Unknown"])


def p2_found(spark, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("candidate_id", "group_book_key", "group_plot_index")


def p2_splits(spark, sf_dir: str) -> DataFrame:
    """``candidate_id, group_book_key, group_plot_index, split_label``."""
    grouped = cut(_grouped(spark, sf_dir), "grouped")
    targets = {r["split_label"]: float(r["share_percent"]) for r in table(spark, sf_dir, "split_targets").collect()}  # three rows
    placed = assign(grouped, _labels(table(spark, sf_dir, "candidates")), "candidate_id", targets)
    return grouped.join(placed, "group_id").select("candidate_id", "group_book_key", "group_plot_index", "split_label")


def p2_balance(spark, sf_dir: str) -> DataFrame:
    """``split_label, records, record_share``."""
    splits = p2_splits(spark, sf_dir).groupBy("split_label").agg(F.count("*").alias("records"))
    total = splits.agg(F.sum("records").alias("total"))
    return splits.join(F.broadcast(total)).select("split_label", "records", (F.col("records") / F.col("total")).alias("record_share"))


def p2_members(spark, sf_dir: str) -> DataFrame:
    """Every candidate with its group, in how many splits it is, and in how many its group is."""
    out = cut(p2_splits(spark, sf_dir), "members")
    own = out.groupBy("candidate_id", "group_book_key", "group_plot_index").agg(F.count_distinct("split_label").alias("splits"))
    whole = out.groupBy("group_book_key", "group_plot_index").agg(F.count_distinct("split_label").alias("splits_of_group"))
    return own.join(whole, (own["group_book_key"].eqNullSafe(whole["group_book_key"])) & (own["group_plot_index"].eqNullSafe(whole["group_plot_index"]))).select("candidate_id", own["group_book_key"], own["group_plot_index"], "splits", "splits_of_group")
