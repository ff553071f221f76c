"""Operators on ordered rows: runs, prefixes, contexts, carried state, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import text as T


def _ordered(keys: Sequence[str], order: Sequence[str | Column]) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "run") -> DataFrame:
    """Number the runs of equal successive values from 0; nulls are equal to each other."""
    w = _ordered(keys, order)
    marked = df.withColumn("_v", value)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1)
    return marked.withColumn("_c", change).withColumn(name, F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_v", "_c")


def joined_in_order(order: Sequence[str], text: Column, separator: str) -> Column:
    """An aggregate: texts joined in the given order; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_t"))))), lambda x: x["_t"]), separator)


def merge_speakers(lines: DataFrame, keys: Sequence[str], order: Sequence[str], separator: str = "\n") -> DataFrame:
    """``keys, run, speaker, content, lines``: successive lines of one speaker become one."""
    marked = runs(lines, keys, order, F.col("speaker"))
    return marked.groupBy(*keys, "run", "speaker").agg(joined_in_order(order, F.col("content"), separator).alias("content"), F.count("*").alias("lines"))


def role_samples(lines: DataFrame, keys: Sequence[str], order: Sequence[str], narrator: str = T.NARRATOR) -> DataFrame:
    """``keys, target, turn, role, content, loss``: one chat sample for each speaker of a conversation.

    The target's lines are the assistant's, with loss; all others are the
    user's.  Lines show their speaker.  Successive lines of one role are joined
    by newlines; what follows the last assistant turn goes; a conversation in
    which the target doesn't speak gives no sample.
    """
    merged = merge_speakers(lines, keys, order)
    targets = merged.filter((F.col("speaker") != narrator) & (T.strip(F.col("speaker")) != "")).select(*keys, F.col("speaker").alias("target")).distinct()
    wide = merged.join(targets, list(keys))
    role = F.when(F.col("speaker") == F.col("target"), "assistant").otherwise("user")
    said = T.speaker_line(F.col("speaker"), F.col("content"))
    marked = runs(wide.withColumns({"role": role, "said": said}), [*keys, "target"], ["run"], F.col("role"), "turn")
    turns = marked.groupBy(*keys, "target", "turn", "role").agg(joined_in_order(["run"], F.col("said"), "\n").alias("content"))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy(*keys, "target"))
    kept = turns.withColumn("_last", last).filter(F.col("turn") <= F.col("_last")).drop("_last")
    return kept.withColumn("loss", F.when(F.col("role") == "assistant", F.lit(True)))


def adjacent_context(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], section: Column, sentences: Column, most: int) -> DataFrame:
    """Add ``previous_context`` and ``next_context``: the last sentences of the chunk before and the first of the one after, inside a section."""
    w = _ordered(keys, order)
    df = chunks.withColumns({"_sec": section, "_s": sentences})
    df = df.withColumns({"_ps": F.lag("_sec").over(w), "_p": F.lag("_s").over(w), "_ns": F.lead("_sec").over(w), "_n": F.lead("_s").over(w)})
    tail = F.slice("_p", F.greatest(F.size("_p") - most + 1, F.lit(1)), most)
    before = F.when(F.col("_p").isNotNull() & F.col("_ps").eqNullSafe(F.col("_sec")) & (F.size("_p") > 0), F.array_join(tail, "")).otherwise("")
    after = F.when(F.col("_n").isNotNull() & F.col("_ns").eqNullSafe(F.col("_sec")), F.array_join(F.slice("_n", 1, most), "")).otherwise("")
    return df.withColumns({"previous_context": before, "next_context": after}).drop("_sec", "_s", "_ps", "_p", "_ns", "_n")


def section_ends(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], section: Column, name: str = "section_end") -> DataFrame:
    """Mark the last row of each section: no row follows, or its section differs."""
    w = _ordered(keys, order)
    df = chunks.withColumn("_sec", section)
    following = F.lead(F.struct("_sec")).over(w)
    return df.withColumn(name, following.isNull() | ~following["_sec"].eqNullSafe(F.col("_sec"))).drop("_sec")


def fixed_blocks(chunks: DataFrame, keys: Sequence[str], at: str, size: int, text: str) -> DataFrame:
    """``keys, block, first, last, n, text``: blocks of ``size`` successive chunks that never cross a group."""
    placed = chunks.withColumn("_rn", F.row_number().over(_ordered(keys, [at])) - 1).withColumn("block", F.floor(F.col("_rn") / size).cast("int"))
    return placed.groupBy(*keys, "block").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), joined_in_order([at], F.col(text), "").alias("text"))


def fill_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, name: str = "filled") -> DataFrame:
    """A missing position is the next known one, else the previous, else 0."""
    w = _ordered(keys, order)
    after = F.first(position, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    before = F.last(position, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(F.col(position), after, before, F.lit(0)))


def contiguous_prefix(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Per group ``n``, ``prefix``, ``complete``: how many distinct indexes, how long they run 0, 1, 2 .. without a gap."""
    each = df.select(*keys, index).filter(F.col(index).isNotNull()).distinct()
    ranked = each.withColumn("_ok", F.col(index) == F.row_number().over(_ordered(keys, [index])) - 1)
    # Distinct sorted indexes agree with their rank up to the first gap and never after it.
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_ok").alias("prefix"), F.bool_and("_ok").alias("complete"))


def range_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Ranges, ends included, that begin before an earlier one has ended."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("reached", before).filter(F.col("reached") >= F.col(start))


def keep_first(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key and position; rows without a position all stay."""
    w = W.partitionBy(*keys, position).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) | F.col(position).isNull()).drop("_rn")


def history_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], line: Column, name: str = "history") -> DataFrame:
    """All earlier lines of the group, one per row of text."""
    w = _ordered(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_l", line).withColumn(name, F.array_join(F.collect_list("_l").over(w), "\n")).drop("_l")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: str, watched: Sequence[str]) -> DataFrame:
    """For each watched state, its latest value from all earlier rows: columns ``carried_<state>``."""
    w = _ordered(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({f"carried_{s}": F.last(F.when(F.col(name) == s, F.col(value)), ignorenulls=True).over(w) for s in watched})


def offset_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column) -> DataFrame:
    """Add ``offset_start`` and ``offset_end``: half-open places of the rows when joined."""
    w = _ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_n", size).withColumn("offset_end", F.sum("_n").over(w))
    return df.withColumn("offset_start", F.col("offset_end") - F.col("_n")).drop("_n")


def trim_context(messages: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, is_user: Column, budget: int) -> DataFrame:
    """The newest whole turns that fit the budget together; ``oversize`` marks groups whose newest turn alone doesn't fit, which keep none.

    A turn begins with a user row; rows before the first are turn 0.
    """
    w = _ordered(keys, order)
    df = messages.withColumn("turn", F.sum(F.coalesce(is_user, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.coalesce(size, F.lit(0)))
    turns = df.groupBy(*keys, "turn").agg(F.sum("_n").alias("_turn"))
    down = W.partitionBy(*keys).orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    fitted = turns.withColumn("_sum", F.sum("_turn").over(down)).withColumn("oversize", F.max(F.struct("turn", "_turn")).over(W.partitionBy(*keys))["_turn"] > budget)
    return df.join(fitted.select(*keys, "turn", "_sum", "oversize"), [*keys, "turn"]).filter(F.col("_sum") <= budget).drop("_n", "_sum")


def intervals(starts: DataFrame, keys: Sequence[str], start: str, total: str) -> DataFrame:
    """``keys, interval, start, end`` from start places: each ends where the next begins, the last at the total; place 0 always starts one."""
    all_ = starts.select(*keys, F.col(start).alias("start"), total).unionByName(starts.select(*keys, F.lit(0).alias("start"), total)).distinct()
    w = _ordered(keys, ["start"])
    return all_.filter(F.col("start") < F.col(total)).select(*keys, (F.row_number().over(w) - 1).alias("interval"), "start", F.lead("start", 1).over(w).alias("_next"), total).select(*keys, "interval", "start", F.coalesce("_next", total).alias("end"))


def first_appearance(lines: DataFrame, keys: Sequence[str], order: Sequence[str], who: str) -> DataFrame:
    """``keys, who, place``: who speaks, numbered from 0 by the first line."""
    first = lines.filter(F.col(who).isNotNull()).groupBy(*keys, who).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(*keys, who, (F.row_number().over(W.partitionBy(*keys).orderBy("_first", who)) - 1).alias("place"))


def repair_nodes(nodes: DataFrame, repairs: DataFrame, keys: Sequence[str], name: str, at: str, value: str) -> DataFrame:
    """Replace the k-th node of a name by the k-th repair of that name; further repairs are appended."""
    k = lambda df: df.withColumn("_k", F.row_number().over(W.partitionBy(*keys, name).orderBy(at)))
    a, b = k(nodes).withColumn("_old", F.lit(True)), k(repairs).select(*keys, name, "_k", F.col(value).alias("_new"), F.col(at).alias("_at"))
    both = a.join(b, [*keys, name, "_k"], "full_outer")
    return both.select(*keys, name, F.coalesce("_new", value).alias(value), F.coalesce(F.col(at), F.col("_at")).alias(at), F.col("_new").isNotNull().alias("repaired"), F.col("_old").isNull().alias("appended"))
