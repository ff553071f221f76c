"""Writing tables as JSON documents, chat samples and profile files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.sources.files import exists, read_jsonl


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; nulls are left out; the commit protocol makes it whole or nothing."""
    df.write.mode(mode).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results of finished units, added to those there are; the order is restored on reading."""
    df.write.mode("append").json(path)


def write_checked(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> int:
    """Write, read back, and check count and uniqueness of the key; returns the count."""
    write_jsonl(df, path, mode)
    spark = df.sparkSession
    back = read_jsonl(spark, path, df.select(key).schema.simpleString()[len("struct<") : -1].replace(":", " "))
    facts = back.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
    if facts["n"] != facts["keys"]:
        raise ValueError(f"{facts['n'] - facts['keys']} keys occur twice in {path}")
    return facts["n"]


def chat_rows(samples: DataFrame, keys: list[str], target: str, turn: str) -> DataFrame:
    """``keys, target, messages``: turns as arrays of role, content and loss, in order."""
    item = F.struct(turn, F.struct("role", "content", "loss").alias("m"))
    return samples.groupBy(*keys, target).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))


def write_chat(samples: DataFrame, path: str, keys: list[str], target: str = "target", turn: str = "turn") -> None:
    """All samples as ``messages`` lines under ``all``, and once more by character under ``by_character``; a null loss is left out."""
    rows = chat_rows(samples, keys, target, turn)
    rows.select("messages").write.mode("overwrite").json(f"{path}/all")
    rows.select("messages", F.coalesce(F.nullif(T.safe_filename(F.col(target)), F.lit("")), F.lit("character")).alias("character")).write.mode("overwrite").partitionBy("character").json(f"{path}/by_character")


def write_profiles(profiles: DataFrame, path: str) -> list[str]:
    """``name, profile`` as one text file each, ``<number>-<safe name>.txt``; returns the files' names.

    Spark writes a folder per file; the driver then moves each to its name,
    which touches no contents.
    """
    from inkloom.operators.ranking import global_row_number

    spark = profiles.sparkSession
    numbered = global_row_number(profiles.select("name", "profile"), ["name"], "_n")
    file = F.concat(F.format_string("%04d-", "_n"), F.coalesce(F.nullif(T.safe_filename(F.col("name")), F.lit("")), F.lit("character")), F.lit(".txt"))
    numbered.select(file.alias("file"), F.col("profile").alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for status in system.listStatus(root):
        folder = status.getPath()
        if not folder.getName().startswith("file="):
            continue
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getName()[len("file=") :])
        part = next(p.getPath() for p in system.listStatus(folder) if p.getPath().getName().startswith("part-"))
        system.rename(part, jvm.Path(root, name))
        system.delete(folder, True)
        names.append(name)
    return sorted(names)


def free_folder(spark, root: str, slug: str) -> str:
    """A folder below root that doesn't exist: the slug, or the slug with the next number."""
    if "/" in slug or slug in ("", ".", ".."):
        raise ValueError("a folder name must not leave its root")
    path, n = f"{root.rstrip('/')}/{slug}", 1
    while exists(spark, path):
        n += 1
        path = f"{root.rstrip('/')}/{slug}-{n}"
    return path


def issues(df: DataFrame, code: str, message, *context: str) -> DataFrame:
    """``code, message, context``: rows as diagnostics, the named columns as JSON."""
    return df.select(F.lit(code).alias("code"), message.alias("message"), F.to_json(F.struct(*context)).alias("context"))
