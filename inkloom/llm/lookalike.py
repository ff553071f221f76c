"""Problem 5: visually identical text in different characters, brought to one form.

Texts are first mapped in SQL: invisible characters go, blanks become spaces,
letters of other scripts become the letters they look like.  The mapped values
are grouped under an accent-sensitive Unicode collation, which finds width
forms, ligatures, radicals and composed accents equal.  Each class with more
than one form gets a canonical member, joined back to the rows.

Only rows whose scope and coarse values (the mapped values without marks and
blanks, hashed) occur in more than one form are grouped; all members of a class
with several forms are among them.

The collation also finds forms equal that a reader can tell apart (case, small
kana, raised digits).  So the members of such classes, a small part, get an
exact form: compatibility decomposition of width and presentation forms only.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.session import cut, table

COLLATION = "UNICODE_CI"

# Characters without a shape of their own.
INVISIBLE = "".join(map(chr, [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x206A, 0x206B, 0x206C, 0x206D, 0x206E, 0x206F, 0x3164, 0xFE00, 0xFE01, 0xFE02, 0xFE03, 0xFE04, 0xFE05, 0xFE06, 0xFE07, 0xFE08, 0xFE09, 0xFE0A, 0xFE0B, 0xFE0C, 0xFE0D, 0xFE0E, 0xFE0F, 0xFEFF, 0xFFA0, 0xFFF9, 0xFFFA, 0xFFFB]))
# Blanks that look like a space.
BLANKS = "".join(map(chr, [0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000]))
# Letters and marks, and what they look like; one column of each line stands for one character.
ALIKE = [
    ("аеорсухіјѕԁһԛԝӏцвкмнтгьпб", "aeopcyxijsdhqwl" + "цвкмнтгьпб"),
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮ", "ABESIJKMHOPCTYXGQWY"),
    ("ѐёѝїӑӓӧӱҫ", "èëѝïăäöӱç"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ABEZHIKMNOPTYXCM"),
    ("ονιαϲϳυ", "ovιαcju"),
    ("ɑɡıℓ", "agıl"),
    ("օոսցհ", "onugh"),
    ("‐‑‒﹣－⁃˗", "-------"),
    ("’‘ʼʹ＇‛", "''''''"),
    ("‚，", ",,"),
    ("″〃", '""'),
    ("∶：ː", ":::"),
    ("․．", ".."),
    ("⁎∗＊", "***"),
    ("∕⁄／", "///"),
    ("ǃ！", "!!"),
    ("⟨〈‹", "<<<"),
    ("⟩〉›", ">>>"),
    ("∼～˜", "~~~"),
    ("｡｢｣､･", "。「」、・"),
]
#: What doesn't show at the ends of a text.
ENDS = " \t\n\r\x0b\x0c\x85\u2028\u2029"
#: Tags of compatibility decompositions after which a character looks the same.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>"}


def _pairs() -> dict[str, str]:
    out = {b: " " for b in BLANKS}
    for a, b in ALIKE:
        if len(a) != len(b):
            raise ValueError(f"unequal lines: {a} {b}")
        out |= {x: y for x, y in zip(a, b) if x != y}
    return out


def exact_form(text: str) -> str:
    """One string for all texts that look the same: mapped, without width and presentation forms, composed."""
    pairs = _pairs()
    out = []
    for c in unicodedata.normalize("NFD", text):
        if c in INVISIBLE:
            continue
        c = pairs.get(c, c)
        tag = unicodedata.decomposition(c).split(" ")[0]
        # Marks of their own, which decompose to a blank with a mark, stay.
        plain = unicodedata.normalize("NFKC", c) if tag in SAME_LOOK else c
        c = c if plain[:1] == " " and len(plain) > 1 else plain
        out.append("".join(pairs.get(x, x) for x in c))
    return unicodedata.normalize("NFC", "".join(pairs.get(x, x) for x in unicodedata.normalize("NFC", "".join(out)))).strip(ENDS)


@lru_cache(maxsize=1)
def special_characters() -> str:
    """All characters that aren't their own exact form within a text, and those that compose with the one before."""
    mapped_, out = {*_pairs(), *INVISIBLE}, []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        composes = unicodedata.category(c)[0] == "M" or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2
        # A character that is neither mapped nor decomposed is its own exact form.
        if composes or ((c in mapped_ or unicodedata.decomposition(c)) and exact_form(f"x{c}x") != f"x{c}x"):
            out.append(c)
    return "".join(out)


@lru_cache(maxsize=1)
def _single_characters() -> dict[str, str]:
    """The look-alikes, and all special characters whose exact form is one other character."""
    exact = {c: exact_form(f"x{c}x")[1:-1] for c in special_characters() if unicodedata.category(c)[0] != "M"}
    return {c: e for c, e in exact.items() if len(e) == 1 and c not in INVISIBLE} | {c: e for c, e in _pairs().items()}


@lru_cache(maxsize=1)
def _several_characters() -> dict[str, str]:
    """All special characters whose exact form is several characters."""
    exact = {c: exact_form(f"x{c}x")[1:-1] for c in special_characters() if unicodedata.category(c)[0] != "M"}
    return {c: e for c, e in exact.items() if len(e) > 1}


def _expanded(text: Column) -> Column:
    """Characters that look like several others replaced by those; the ellipsis, the only frequent one, by itself."""
    text, several = F.replace(text, F.lit("…"), F.lit("...")), _several_characters()
    listed = F.split(F.lit("\x02".join(c + e for c, e in several.items() if c != "…")), "\x02")
    replaced = F.aggregate(listed, text, lambda t, p: F.replace(t, F.left(p, F.lit(1)), F.substring(p, F.lit(2), F.lit(20))))
    return F.when(F.translate(text, "".join(several), "") != text, replaced).otherwise(text)


def mapped(text: Column) -> Column:
    """Look-alikes and blanks mapped, invisible characters gone, ends trimmed; null stays null."""
    one = _single_characters()
    return F.btrim(F.translate(_expanded(text), "".join(one) + INVISIBLE, "".join(one.values())), F.lit(ENDS))


@lru_cache(maxsize=1)
def _coarse_characters() -> tuple[str, str]:
    """Composed characters and their bases, then marks and blanks, which go; of a Hangul syllable its first letter stays."""
    bases, gone = {}, []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0] if unicodedata.category(c) != "Cs" else c
        if unicodedata.category(c)[0] in "MZ" or c in ENDS or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2:
            gone.append(c)
        elif base != c:
            bases[c] = base
    return "".join(bases) + "".join(gone), "".join(bases.values())


def coarse(text: Column) -> Column:
    """A value that all texts of one exact form share."""
    return F.translate(mapped(text), *_coarse_characters())


def _exact(values: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return values.map(lambda v: None if v is None else known.get(v) or known.setdefault(v, exact_form(v)))


def visible(text: Column) -> Column:
    """Whether anything is to be seen; false for null."""
    return F.coalesce(text.rlike(r"[^\s\p{Cc}\p{Cf}\p{Z}\x{2800}" + INVISIBLE + "]"), F.lit(False))


def suspects(rows: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """The rows whose scope and coarse values occur in more than one form; all rows of classes with several forms are among them.

    Only hashes are shuffled to find them.  Rows with a null scope or a column
    that is null or shows nothing are no cases.
    """
    shown = rows.filter(F.col(scope).isNotNull())
    for c in columns:
        shown = shown.filter(visible(F.col(c)))
    keyed = shown.withColumns({"_coarse": F.xxhash64(*[coarse(F.col(c)) for c in columns]), "_form": F.xxhash64(*columns)})
    many = keyed.groupBy(scope, "_coarse").agg(F.min("_form").alias("lo"), F.max("_form").alias("hi")).filter("lo <> hi").select(scope, "_coarse")
    return keyed.join(many, [scope, "_coarse"], "left_semi").drop("_coarse", "_form")


def equal_looking(rows: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """The forms of classes that hold more than one: ``scope``, the columns, ``exact`` and the canonical values ``canonical_<column>``.

    A form is a distinct combination of the columns' code points in its scope;
    ``rows`` may be all rows or their ``suspects``.  Repeated rows are one form.
    The canonical member is the one closest to its exact form, then the least.
    """
    exact = F.pandas_udf(_exact, "string")
    forms = rows.select(scope, *columns).distinct()
    keyed = forms.withColumns({f"_{c}": F.collate(mapped(F.col(c)), COLLATION) for c in columns})
    keys = [scope, *[f"_{c}" for c in columns]]
    form = F.struct(*columns)
    many = keyed.groupBy(*keys).agg(F.min(form).alias("lo"), F.max(form).alias("hi")).filter("lo <> hi").select(*keys)
    # The classes come back to their forms on the collated keys.
    members = keyed.join(many, keys).select(scope, *columns)
    members = members.withColumn("exact", F.concat_ws("\u0001", *[exact(F.col(c)) for c in columns]))
    distance = sum((F.length(F.col(c)) for c in columns), F.lit(0))
    own = F.concat_ws("\u0001", *columns)
    best = members.groupBy(scope, "exact").agg(F.count("*").alias("forms"), F.min_by(F.struct(*columns), F.struct(own != F.col("exact"), distance, *columns)).alias("best")).filter("forms > 1")
    return members.join(best, [scope, "exact"]).select(scope, *columns, "exact", *[F.col(f"best.{c}").alias(f"canonical_{c}") for c in columns])


def pairs(rows: DataFrame, key: str, scope: str, columns: list[str]) -> DataFrame:
    """``<key>_a, <key>_b``, a < b: rows of one scope that look the same in all columns and differ in code points."""
    slim = cut(suspects(rows.filter(F.col(key).isNotNull()).select(key, scope, *columns), scope, columns), "suspects")
    forms = equal_looking(slim, scope, columns).select(scope, *columns, "exact")
    members = cut(slim.join(forms, [scope, *columns]).select(key, scope, *columns, "exact").distinct(), "alike")
    # Forms are paired, not rows: many rows of one form meet only the rows of other forms.
    form = members.withColumn("form", F.concat_ws("\u0001", *columns)).select(key, scope, "exact", "form")
    kinds = form.select(scope, "exact", "form").distinct()
    x, y = kinds.withColumnRenamed("form", "form_a"), kinds.withColumnRenamed("form", "form_b")
    other = x.join(y, [scope, "exact"]).filter("form_a <> form_b").select(scope, "form_a", "form_b")
    a = form.select(scope, F.col("form").alias("form_a"), F.col(key).alias(f"{key}_a"))
    b = form.select(scope, F.col("form").alias("form_b"), F.col(key).alias(f"{key}_b"))
    return other.join(a, [scope, "form_a"]).join(b, [scope, "form_b"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "utterances"), "utterance_id", "book_key", ["speaker", "content"])


def p5_canonical(spark, sf_dir: str) -> DataFrame:
    """Every utterance with its speaker and content in canonical form."""
    rows = table(spark, sf_dir, "utterances").select("utterance_id", "book_key", "speaker", "content")
    forms = cut(equal_looking(suspects(rows, "book_key", ["speaker", "content"]), "book_key", ["speaker", "content"]).select("book_key", "speaker", "content", "canonical_speaker", "canonical_content"), "forms")
    out = rows.distinct().join(forms, ["book_key", "speaker", "content"], "left")
    return out.select("utterance_id", "book_key", F.coalesce("canonical_speaker", "speaker").alias("speaker"), F.coalesce("canonical_content", "content").alias("content"))
