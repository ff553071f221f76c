"""Problem 9: filling containers of fixed capacity, sum-of-squares online packing.

Items go to shards by hash; in a shard each item is placed into the fill level
that minimises the sum of the squared numbers of partially filled containers,
kept in an array by level.  What lies in containers that stay short of
``CLOSED_AT`` is packed again over fewer shards, until one shard is left or
the shards don't get fewer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm import bpe
from inkloom.llm.tokens import count_tokens
from inkloom.session import cut, table

#: Items in one shard, about; a shard is one task's work.
SHARD_ITEMS = 20_000
#: Share of the capacity from which a container is final.
CLOSED_AT = 0.97

_PACKED = "doc_id bigint, piece_index bigint, tokens bigint, container_id string, level bigint"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each size (1..capacity), in the given order.

    Placing size s at level h changes the sum of squares by
    2*(N[h+s] - N[h] + 1), or by 2*N[s] + 1 for a new container; a full level
    counts nothing.  Ties go to the fuller container.
    """
    number = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    levels = np.arange(capacity + 1)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        room = capacity - s
        target = number[s : capacity + 1]
        cost = 2 * (target - number[: room + 1]) + 2
        cost[0] = 2 * target[0] + 1
        cost[room] = (1 - 2 * number[room]) if room else 0
        open_ = number[: room + 1] > 0
        open_[0] = True
        allowed = levels[: room + 1][open_]
        costs = cost[: room + 1][open_]
        h = int(allowed[len(costs) - 1 - int(np.argmin(costs[::-1]))])
        if h:
            box = stacks[h].pop()
            number[h] -= 1
        else:
            box, made = made, made + 1
        out[i] = box
        if h + s < capacity:
            stacks[h + s].append(box)
            number[h + s] += 1
    return out


def _pack_shard(capacity: int, label: str):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["order_key", "doc_id", "piece_index"], kind="stable")
        box = sum_of_squares(items["tokens"].to_numpy(np.int64), capacity)
        level = np.bincount(box, weights=items["tokens"].to_numpy(float)).astype(np.int64)[box] if len(box) else box
        return pd.DataFrame({"doc_id": items["doc_id"].to_numpy(), "piece_index": items["piece_index"].to_numpy(), "tokens": items["tokens"].to_numpy(), "container_id": [f"{label}-{key[0]}-{b}" for b in box], "level": level})

    return run


def pack(sized: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, piece_index, piece_start, tokens, container_id`` from ``doc_id, n_tokens``.

    A row of more than ``capacity`` tokens is cut into full containers and a
    rest; others stay whole.  Rows without tokens, or with a null number, need
    no place and give no row.  Repeated ids are items of their own only if
    they differ in size; the same row again is the same item.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    items = sized.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")).distinct()
    cuts = items.select("doc_id", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")).alias("piece_index"), "n_tokens")
    cuts = cuts.select("doc_id", "piece_index", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece_index") * capacity).alias("tokens"))
    full = cuts.filter(F.col("tokens") == capacity).select("doc_id", "piece_index", "tokens", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_index").cast("string")).alias("container_id"))
    open_items = cuts.filter(F.col("tokens") < capacity)
    parts = [full]
    turn, before = 0, math.inf
    while True:
        shards = max(1, math.ceil(open_items.count() / shard_items))
        last = shards == 1 or shards >= before
        keyed = open_items.withColumn("order_key", F.xxhash64("doc_id", "piece_index", F.lit(turn))).withColumn("shard", F.pmod("order_key", F.lit(shards)))
        packed = keyed.groupBy("shard").applyInPandas(_pack_shard(capacity, f"r{turn}"), _PACKED)
        if last:
            parts.append(packed.drop("level"))
            break
        packed = cut(packed, "packed")
        closed = F.col("level") >= int(CLOSED_AT * capacity)
        parts.append(packed.filter(closed).drop("level"))
        open_items = packed.filter(~closed).select("doc_id", "piece_index", "tokens")
        turn, before = turn + 1, shards
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece_index", (F.col("piece_index") * capacity).alias("piece_start"), "tokens", "container_id")


def capacity_of(spark, sf_dir: str) -> int:
    """The capacity in the four-row table of limits."""
    row = table(spark, sf_dir, "size_limits").filter("setting_name = 'container_capacity_tokens'").first()
    return int(row["setting_value"])


def p9_containers(spark, sf_dir: str) -> DataFrame:
    sized = cut(count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=bpe.DEFAULT_TOKENIZER).filter("n_tokens > 0"), "sized")
    return pack(sized, capacity_of(spark, sf_dir))


def p9_fill(spark, sf_dir: str) -> DataFrame:
    """One row: containers used, the least number possible, and the share of room in use."""
    capacity = capacity_of(spark, sf_dir)
    boxes = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("level"))
    least = F.ceil(F.sum("level") / F.lit(float(capacity)))
    return boxes.agg(F.count("*").alias("containers"), least.cast("bigint").alias("least_containers"), (F.sum("level") / (F.count("*") * F.lit(float(capacity)))).alias("fill_share"))


def p9_placed(spark, sf_dir: str) -> DataFrame:
    """``doc_id, whole, fits``: of every document with tokens, whether its pieces are the fewest possible and add up to it, and whether its containers hold no more than they can."""
    capacity = capacity_of(spark, sf_dir)
    sized = cut(count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=bpe.DEFAULT_TOKENIZER).filter("n_tokens > 0"), "sized")
    placed = cut(pack(sized, capacity), "placed")
    full = placed.groupBy("container_id").agg(F.sum("tokens").alias("level"))
    each = placed.join(full, "container_id").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.max("level").alias("most"))
    return each.join(sized.select("doc_id", "n_tokens"), "doc_id").select("doc_id", ((F.col("tokens") == F.col("n_tokens")) & (F.col("parts") == F.ceil(F.col("n_tokens") / F.lit(float(capacity))))).alias("whole"), (F.col("most") <= capacity).alias("fits"))
