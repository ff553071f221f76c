"""Problem 7: cutting oversized items at natural boundaries, by one bounded-quantifier regex.

The alternatives run from the strongest boundary to none: the rest of the
text, a paragraph, a line, a sentence, a clause, a blank, the end of a
character, any code point.  Each is greedy, so it ends at its last boundary
within the limit; boundaries in the first half of the window are passed over
for weaker ones further on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.session import table

# Marks that end a sentence or a clause, and marks that close after them.
ENDS_WIDE, ENDS_NARROW = "。！？｡…", ".!?…"
CLAUSE_WIDE, CLAUSE_NARROW = "，、；：—", ",;:—–"
CLOSERS = "\"'”’』」»）)】\\]*"


def piece_pattern(size: int) -> str:
    """A regex whose successive matches cover a text in pieces of 1..size code points."""
    if size < 2:
        return "(?s)."
    low, top = max(1, size // 2), size
    window = f".{{{low},{top}}}"
    return "(?s)" + "|".join(
        [
            f".{{1,{top}}}\\z",
            f"{window}(?<=(?:\\r\\n|\\n|\\r)[ \\t]{{0,8}}(?:\\r\\n|\\n|\\r))(?![\\r\\n])",
            f"{window}(?<=[\\n\\r])(?<!\\r(?=\\n))",
            f"{window}(?:(?<=[{ENDS_WIDE}][{CLOSERS}]{{0,3}})|(?<=[{ENDS_NARROW}][{CLOSERS}]{{0,3}}\\s))(?![{ENDS_WIDE}{CLOSERS}])",
            f"{window}(?:(?<=[{CLAUSE_WIDE}])|(?<=[{CLAUSE_NARROW}]\\s))(?![{CLAUSE_WIDE}{CLOSERS}])",
            f"{window}(?<=\\s)(?!\\s)",
            f".{{1,{top}}}(?![\\p{{M}}\\x{{200d}}\\x{{fe0f}}])(?<!\\x{{200d}})",
            f".{{1,{top}}}",
        ]
    )


def split_oversized(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``item_kind, item_id, piece_index, piece_start, piece_end, text`` of the items longer than ``limit``.

    ``items`` has item_kind, item_id, text.  Offsets count code points, half
    open.  Every piece but the first begins with the last ``overlap`` code
    points of the one before, no piece is longer than ``limit``, and the pieces
    without overlaps give the text again.  Null, empty and short texts give no
    row; a repeated row gives no second set of pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    long = items.filter(F.length("text") > limit).select("item_kind", "item_id", "text")
    bodies = long.withColumn("bodies", F.regexp_extract_all("text", F.lit(piece_pattern(limit - overlap)), F.lit(0)))
    return bodies.withColumn("ends", running_sums(F.transform("bodies", F.length)))


def running_sums(sizes: Column, block: int = 256) -> Column:
    """The running sums of an array of numbers, by blocks, so that the work doesn't grow with the square of its length."""
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(block)), lambda at: F.slice(sizes, at + 1, F.lit(block)))
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    inside = F.transform(blocks, lambda b: F.aggregate(b, none, add))
    before = F.aggregate(F.transform(inside, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))), none, add)
    return F.flatten(F.zip_with(inside, before, lambda b, end: F.transform(b, lambda x: x + end - F.try_element_at(b, F.lit(-1)))))


def pieces(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of all oversized items, one row each; see ``split_oversized``."""
    # Repeats go before the texts are cut.
    once = items.filter(F.length("text") > limit).dropDuplicates(["item_kind", "item_id", "text"])
    found = split_oversized(once, limit, overlap)
    each = found.select("item_kind", "item_id", "text", "ends", F.posexplode("bodies").alias("piece_index", "body"))
    end = F.element_at("ends", F.col("piece_index") + 1)
    start = F.greatest(F.lit(0), end - F.length("body") - F.lit(overlap))
    return each.select("item_kind", "item_id", "piece_index", start.alias("piece_start"), end.alias("piece_end"), F.substring("text", start + 1, end - start).alias("text"))


def _items(spark, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "text_chunks").select(F.lit("text_chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    plot = table(spark, sf_dir, "plot_chunks").select(F.lit("plot_chunk").alias("item_kind"), F.col("plot_chunk_id").alias("item_id"), "text")
    return text.unionByName(plot)


def _limits(spark, sf_dir: str) -> tuple[int, int]:
    rows = {r["setting_name"]: r["setting_value"] for r in table(spark, sf_dir, "size_limits").filter("setting_name in ('chunk_limit_chars', 'chunk_overlap_chars')").collect()}  # at most two rows
    return int(rows["chunk_limit_chars"]), int(rows["chunk_overlap_chars"])


def p7_found(spark, sf_dir: str) -> DataFrame:
    found = split_oversized(_items(spark, sf_dir), *_limits(spark, sf_dir))
    return found.filter(F.size("bodies") > 1).select("item_kind", "item_id").distinct()


def p7_pieces(spark, sf_dir: str) -> DataFrame:
    return pieces(_items(spark, sf_dir), *_limits(spark, sf_dir))


def p7_cover(spark, sf_dir: str) -> DataFrame:
    """``item_kind, item_id, chars, text_md5, fits, overlaps``: each item put together from its pieces again, whether all are within the limit, and whether each begins with the end of the one before."""
    limit, overlap = _limits(spark, sf_dir)
    found = pieces(_items(spark, sf_dir), limit, overlap)
    listed = F.array_sort(F.collect_list(F.struct("piece_index", "piece_start", "piece_end", "text")))
    whole = found.groupBy("item_kind", "item_id").agg(listed.alias("p"), F.max(F.length("text")).alias("longest"))
    later = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    body = F.concat(F.col("p")[0]["text"], F.array_join(F.transform(later, lambda x: F.substring(x["text"], F.lit(overlap + 1), F.length(x["text"]))), ""))
    repeated = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), later, lambda a, b: (b["piece_start"] == a["piece_end"] - overlap) & F.endswith(a["text"], F.left(b["text"], F.lit(overlap)))), lambda x: x)
    return whole.select("item_kind", "item_id", F.length(body).cast("bigint").alias("chars"), F.md5(body).alias("text_md5"), (F.col("longest") <= limit).alias("fits"), repeated.alias("overlaps"))
