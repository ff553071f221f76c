"""Small scalar functions: boxes, sizes, and fields of JSON that may come in several shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """``left, top, right, bottom`` in whole pixels of a picture, from an array of four numbers: outward to full pixels, inside the picture; null if nothing is left.

    A missing or short array, or a corner that isn't a number, gives null.
    """
    corner = [F.try_element_at(box, F.lit(i)).cast("double") for i in range(1, 5)]
    edges = [F.floor(corner[0]), F.floor(corner[1]), F.ceil(corner[2]), F.ceil(corner[3])]
    sizes = [width, height, width, height]
    left, top, right, bottom = (F.least(F.greatest(e, F.lit(0)), s).cast("int") for e, s in zip(edges, sizes))
    known = F.lit(True)
    for c in corner:
        known = known & c.isNotNull() & ~F.isnan(c)
    return F.when(known & (left < right) & (top < bottom), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def byte_size(size: Column) -> Column:
    """A number of bytes with one decimal, in the largest of B, KB, MB, GB, TB that keeps it at least 1; null stays null."""
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", size / F.lit(1024.0**power))).otherwise(out)
    return F.when(size.isNotNull(), out)


def listed_or_in(text: Column, field: str, item: str) -> Column:
    """The items of JSON that is either an array of them or an object with the array under ``field``; null for other JSON."""
    bare = F.regexp_replace(text, r"^[ \t\r\n]+", "")
    return F.when(bare.startswith("["), F.from_json(bare, f"array<{item}>")).when(bare.startswith("{"), F.from_json(bare, f"`{field}` array<{item}>")[field])


def first_present(text: Column, names: Sequence[str]) -> Column:
    """The value, as text, of the first of several fields that a JSON object has and that isn't null."""
    return F.coalesce(*[F.get_json_object(text, f"$['{n}']") for n in names])


def flat_numbers(text: Column) -> Column:
    """All numbers in nested JSON arrays, in order, as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
