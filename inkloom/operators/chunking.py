"""Packing sentences into chunks, and cutting texts into sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import text as T


def pack_ends(sizes: Column, budget: int, crossing: bool = True) -> Column:
    """After how many items each pack ends, for an array of sizes.

    ``crossing``: an item is added first, and a pack ends when it reaches or
    crosses the budget.  Otherwise a pack ends before the item that would make
    it exceed the budget, and a larger item stands alone.  One fold per row;
    its state grows with the packs, not with the items.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("ends"))

    def crossing_step(s: Column, n: Column) -> Column:
        full = s["held"] + n >= budget
        return F.struct(F.when(full, F.lit(0).cast("bigint")).otherwise(s["held"] + n).alias("held"), (s["seen"] + 1).alias("seen"), F.when(full, F.array_append(s["ends"], s["seen"] + 1)).otherwise(s["ends"]).alias("ends"))

    def flushing_step(s: Column, n: Column) -> Column:
        full = (s["held"] > 0) & (s["held"] + n > budget)
        return F.struct(F.when(full, n.cast("bigint")).otherwise(s["held"] + n).alias("held"), (s["seen"] + 1).alias("seen"), F.when(full, F.array_append(s["ends"], s["seen"])).otherwise(s["ends"]).alias("ends"))

    def finish(s: Column) -> Column:
        return F.when(s["held"] > 0, F.array_append(s["ends"], s["seen"])).otherwise(s["ends"])

    return F.aggregate(sizes, start, crossing_step if crossing else flushing_step, finish)


def pack_sentences(rows: DataFrame, keys: Sequence[str], text: str, budget: int, ends: str = T.SENTENCE_ENDS, crossing: bool = True) -> DataFrame:
    """``keys, chunk_index, token_count, text``: sentences packed by code points, no sentence cut, nothing lost.

    Null and blank texts give no row.
    """
    cut = rows.select(*keys, T.split_sentences(T.normalize_newlines(F.col(text)), ends).alias("_s")).filter(F.size("_s") > 0)
    packed = cut.withColumn("_ends", pack_ends(F.transform("_s", F.length), budget, crossing))
    begin = F.when(F.col("chunk_index") == 0, F.lit(0)).otherwise(F.element_at("_ends", F.greatest(F.col("chunk_index"), F.lit(1))))
    each = packed.select(*keys, "_s", "_ends", F.posexplode("_ends").alias("chunk_index", "_end")).withColumn("_begin", begin)
    body = F.array_join(F.slice("_s", F.col("_begin") + 1, F.col("_end") - F.col("_begin")), "")
    return each.select(*keys, "chunk_index", F.length(body).alias("token_count"), body.alias("text"))


def heading_lines(rows: DataFrame, keys: Sequence[str], text: str, markers: Sequence[str]) -> DataFrame:
    """``keys, line_number, heading`` of the lines that are headings, counted from 1."""
    lines = rows.select(*keys, F.posexplode(F.split(T.normalize_newlines(F.col(text)), "\n")).alias("_at", "_line"))
    return lines.filter(F.col("_line").rlike(T.heading_pattern(markers))).select(*keys, (F.col("_at") + 1).alias("line_number"), T.strip(F.col("_line")).alias("heading"))


def split_sections(rows: DataFrame, keys: Sequence[str], text: str, volumes: Sequence[str] = T.VOLUME_HEADINGS, chapters: Sequence[str] = T.CHAPTER_HEADINGS, with_heading: bool = False, front_matter: bool = False) -> DataFrame:
    """``keys, section_index, volume, chapter, heading, body``.

    A volume runs over all its successive heading lines of one label.  If any
    of them names a chapter on the same line, only those lines begin sections;
    else chapter lines do, with a preamble before the first.  Without volumes
    the chapter lines do; without headings the whole text is one section.
    Blank sections go.
    """
    lines = rows.select(*keys, F.posexplode(F.split(T.normalize_newlines(F.col(text)), "\n")).alias("at", "line"))
    volume_core, chapter_core = (T.heading_pattern(m).removeprefix(r"^[ \t\x{3000}]*").removesuffix(r"[^\r\n]*$") for m in (volumes, chapters))
    heading = T.strip(F.col("line"))
    is_volume = F.col("line").rlike(T.heading_pattern(volumes))
    label = F.regexp_extract(heading, volume_core, 0)
    after = F.substring(heading, F.length(label) + 1, F.length(heading))
    same_line = F.when(is_volume, F.nullif(T.strip(F.regexp_extract(after, chapter_core + ".*", 0)), F.lit("")))
    order = W.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumns({"is_volume": is_volume, "label": F.when(is_volume, label), "on_line": same_line, "is_chapter": ~is_volume & F.col("line").rlike(T.heading_pattern(chapters)), "heading": heading})
    marked = marked.withColumn("last", F.last("label", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    marked = marked.withColumn("opens", F.col("is_volume") & ~F.coalesce(F.col("last") == F.col("label"), F.lit(False)))
    marked = marked.withColumn("region", F.sum(F.col("opens").cast("int")).over(so_far))
    region = W.partitionBy(*keys, "region")
    marked = marked.withColumn("inline", F.max(F.col("on_line").isNotNull()).over(region))
    starts = F.when(F.col("region") == 0, F.col("is_chapter")).when(F.col("inline"), F.col("on_line").isNotNull()).otherwise(F.col("opens") | F.col("is_chapter"))
    marked = marked.withColumn("starts", starts).withColumn("any", F.max("starts").over(W.partitionBy(*keys)))
    marked = marked.withColumn("section", F.sum(F.col("starts").cast("int")).over(so_far)).withColumn("volume", F.last("label", ignorenulls=True).over(so_far))
    # Lines before the first section of a region with chapters on its heading lines belong to no section, nor does front matter.
    first_in = F.min(F.when(F.col("starts"), F.col("at"))).over(region)
    outside = F.col("any") & (F.col("at") < F.coalesce(first_in, F.lit(1 << 30)))
    dropped = outside & ~(F.lit(front_matter) & (F.col("section") == 0))
    skipped = F.when(F.col("starts"), F.lit(True)).otherwise(F.lit(False))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~skipped & ~F.col("dropped"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    marked = marked.withColumn("dropped", dropped)
    grouped = marked.groupBy(*keys, "section").agg(body.alias("body"), F.max(F.when(F.col("starts"), F.struct("volume", F.coalesce("on_line", F.when(F.col("is_chapter"), F.col("heading"))).alias("chapter"), "heading"))).alias("h"))
    text_ = T.strip(F.when(F.lit(with_heading) & F.col("h").isNotNull(), F.concat(F.col("h.heading"), F.lit("\n"), "body")).otherwise(F.col("body")))
    out = grouped.withColumn("body", text_).filter("body <> ''")
    return out.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("section")) - 1).alias("section_index"), "h.volume", "h.chapter", F.coalesce("h.heading", F.lit("")).alias("heading"), "body")
