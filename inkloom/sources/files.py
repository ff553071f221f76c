"""Reading texts, JSON documents, profiles, e-books and image folders as DataFrames."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkloom.functions import text as T

# What is an image, and folders that hold none.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif"]
SKIPPED_FOLDERS = ["__MACOSX"]
_BOM = "﻿"


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, text``: whole UTF-8 files without a byte order mark."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^{_BOM}", "").alias("text"))


def _decode(raw: bytes) -> str | None:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else GB18030, else null."""
    return contents.map(lambda b: None if b is None else _decode(bytes(b)))


def read_texts_any(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, text`` with the encoding found out; a file in neither encoding raises."""
    raw = spark.read.format("binaryFile").load(paths).select("path", decoded("content").alias("text"))
    return raw.withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("neither UTF-8 nor GB18030: "), "path"))))


def in_narrative_order(resources: DataFrame) -> DataFrame:
    """Text resources; another type, or an order that occurs twice, raises."""
    from pyspark.sql import Window as W

    checked = resources.withColumn("_n", F.count("*").over(W.partitionBy("narrative_order")))
    bad = F.when(F.lower("resource_type") != "text", F.lit("not a text: ")).when(F.col("_n") > 1, F.lit("the order occurs twice: "))
    return checked.withColumn("path", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, "path"))).otherwise(F.col("path"))).drop("_n").orderBy("narrative_order")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON objects, one a line; blank lines and a byte order mark are skipped, a broken line raises.

    A path that doesn't exist is an error of Spark's; use ``read_jsonl_or_empty``
    where a missing file means no rows.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{_BOM}", "").alias("value")).filter(T.strip(F.col("value")) != "")
    if schema is None:
        return spark.read.option("mode", "FAILFAST").json(path)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``; a missing file has no rows."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """``name, profile`` from ``<name>.txt`` files; an empty file raises, a missing folder has no rows."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "name string, profile string")
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    named = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), T.strip(F.regexp_replace("value", f"^{_BOM}", "")).alias("profile"))
    return named.withColumn("profile", F.when(F.col("profile") == "", F.raise_error(F.concat(F.lit("empty profile: "), "name"))).otherwise(F.col("profile")))


def profile_folder(spark: SparkSession, root: str, title: str, stem: str) -> str | None:
    """The first of the folders named after the title or the stem, with or without a leading number."""
    for name in dict.fromkeys([title, stem, re.sub(r"^\d+[\s._-]*", "", title), re.sub(r"^\d+[\s._-]*", "", stem)]):
        if name and exists(spark, posixpath.join(root, name)):
            return posixpath.join(root, name)
    return None


def chunk_rows(documents: DataFrame) -> DataFrame:
    """Chunks of documents that hold an array of them, with running ids."""
    return documents.select("*", F.posexplode("chunks").alias("chunk_index", "chunk")).withColumn("chunk_name", F.format_string("chunk-%06d", "chunk_index")).drop("chunks")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, directory, page_index, reason``: images below a folder in natural order, from 0; skipped files have a reason and no index.

    Hidden files and folders, and those that begin with ``_``, are not listed at all.
    """
    from inkloom.operators.ranking import global_row_number

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    root = F.lit(folder.rstrip("/").removeprefix("file://"))
    inside = F.regexp_replace(F.expr("substring(path, locate('/', path))"), F.concat(F.lit("^/*"), F.regexp_replace(root, "^/+", ""), F.lit("/")), "")
    parts = F.split(inside, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(SKIPPED_FOLDERS))
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    reason = F.when(hidden, "hidden").when(~suffix.isin(IMAGE_SUFFIXES), "not an image").when(F.col("length") == 0, "empty")
    rows = files.select("path", F.regexp_replace(inside, "/?[^/]*$", "").alias("directory"), T.natural_key(inside).alias("_key"), reason.alias("reason"))
    kept = global_row_number(rows.filter("reason is null").select("path", "directory", "_key"), ["_key", "path"], "_n")
    out = kept.select("path", "directory", (F.col("_n") - 1).cast("int").alias("page_index"), F.lit(None).cast("string").alias("reason"))
    return out.unionByName(rows.filter("reason is not null").select("path", "directory", F.lit(None).cast("int").alias("page_index"), "reason"))


def _spine(raw: bytes) -> list[str]:
    """Image paths of an e-book in reading order, each once."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        base = posixpath.dirname(opf)
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
        order = [e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref") or e.tag == "itemref"]
        out: dict[str, None] = {}
        for idref in order:
            page = posixpath.normpath(posixpath.join(base, items.get(idref, "")))
            if page not in names:
                continue
            for src in re.findall(r"""<(?:img|image)\b[^>]*?(?:src|href)\s*=\s*["']([^"']+)["']""", book.read(page).decode("utf-8", "replace")):
                path = posixpath.normpath(posixpath.join(posixpath.dirname(page), src))
                if path in names:
                    out[path] = None
    return list(out)


def epub_images(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, page_index, image, error``: the images of e-books in reading order; a broken book is one row with the error."""

    def run(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out += [(path, i, image, None) for i, image in enumerate(_spine(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as error:
                    out.append((path, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "page_index", "image", "error"]).astype({"page_index": "Int32"})

    books = spark.read.format("binaryFile").load(paths).select("path", "content")
    return books.mapInPandas(run, "path string, page_index int, image string, error string")


def page_batches(pages: DataFrame, size: int) -> DataFrame:
    """Add ``batch_index``: successive pages of one directory, at most ``size`` together."""
    from pyspark.sql import Window as W

    from inkloom.operators.ranking import global_row_number

    # Directories are successive in page order, so each is numbered by its first page.
    own = W.partitionBy("directory").orderBy("page_index")
    placed = pages.withColumn("_b", F.floor((F.row_number().over(own) - 1) / size))
    first = placed.groupBy("directory", "_b").agg(F.min("page_index").alias("page_index"))
    numbered = global_row_number(first, ["page_index"], "_n").select("directory", "_b", (F.col("_n") - 1).alias("batch_index"))
    return placed.join(numbered, ["directory", "_b"]).drop("_b")


def load_prompt(template: str) -> tuple[str, str]:
    """System and user part of a prompt: the last line of dashes parts them."""
    parts = re.split(r"(?m)^-{10}\s*$", template)
    return ("-" * 10).join(parts[:-1]).strip(), parts[-1].strip()
