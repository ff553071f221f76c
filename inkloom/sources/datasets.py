"""Reading and writing the documents of the offline chain: results, timelines, training and evaluation sets.

Readers check what they read and raise with the key at fault; what is only
left out comes back as rows of issues.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import text as T
from inkloom.operators import sequence as S
from inkloom.sources.files import exists, read_jsonl
from inkloom.sources.sinks import chat_rows, issues, write_checked, write_jsonl

# The roles of chat messages.
CHAT_ROLES = ["system", "user", "assistant"]


def _raise_if(bad: Column, what: str, *context: Column, value: Column) -> Column:
    """``value``, or an error with the context where ``bad`` holds."""
    parts = [x for c in context for x in (F.lit(" "), F.coalesce(c.cast("string"), F.lit("null")))]
    return F.when(bad, F.raise_error(F.concat(F.lit(what), *parts))).otherwise(value)


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line, value`` of JSON lines, ``line`` from 1 within its file; blank lines count but give no row, a broken one raises with its number.

    A file is cut into lines by one task, as only it knows where each begins.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    lines = whole.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("_at", "_line")).filter(T.strip(F.col("_line")) != "")
    parsed = lines.select("file", (F.col("_at") + 1).alias("line"), F.from_json("_line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("value"), "_line")
    broken = F.col("value").isNull() | F.col("value._broken").isNotNull() | ~F.startswith(T.strip(F.col("_line")), F.lit("{"))
    return parsed.select("file", "line", _raise_if(broken, "not a JSON object:", F.col("file"), F.col("line"), value=F.col("value").dropFields("_broken")).alias("value"))


def keyed_results(rows: DataFrame, keys: Sequence[str], result: str, schema: str) -> DataFrame:
    """``keys`` and the fields of each result; a key that occurs twice, a null key and a result that isn't such an object raise."""
    once = W.partitionBy(*keys)
    parsed = rows.withColumns({"_n": F.count("*").over(once), "_v": F.from_json(result, schema)})
    label = F.to_json(F.struct(*keys))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    value = _raise_if(missing, "a key is missing:", label, value=_raise_if(F.col("_n") > 1, "two results of one key:", label, value=_raise_if(F.col("_v").isNull(), "malformed result:", label, value=F.col("_v"))))
    return parsed.select(*keys, value.alias("_v")).select(*keys, "_v.*")


def state_nodes(results: DataFrame, title: str | None = None) -> DataFrame:
    """``plot_index, chunk_index, node_index`` and the fields of each node, from rows with an array ``nodes``; another title raises."""
    rows = results
    if title is not None:
        rows = rows.withColumn("nodes", _raise_if(~F.col("title").eqNullSafe(F.lit(title)), "another title:", F.col("title"), value=F.col("nodes")))
    return rows.select("plot_index", "chunk_index", F.posexplode("nodes").alias("node_index", "_n")).select("plot_index", "chunk_index", "node_index", "_n.*")


def matched_chunks(states: DataFrame, chunks: DataFrame, keys: Sequence[str], meta: Sequence[str]) -> DataFrame:
    """States with the columns of their chunk; a state without one, or one whose metadata differ (nulls are equal), raises."""
    extra = [c for c in chunks.columns if c not in keys and c not in meta]
    side = chunks.select(*keys, *[F.col(m).alias(f"_{m}") for m in meta], *extra, F.lit(True).alias("_held"))
    joined = states.join(side, list(keys), "left")
    same = F.lit(True)
    for m in meta:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    label = F.to_json(F.struct(*keys))
    first = keys[0]
    checked = _raise_if(F.col("_held").isNull(), "no such chunk:", label, value=_raise_if(~same, "metadata differ:", label, value=F.col(first)))
    return joined.withColumn(first, checked).drop("_held", *[f"_{m}" for m in meta])


def scene_texts(chunks: DataFrame, covered: DataFrame, keys: Sequence[str], index: str, text: str) -> DataFrame:
    """``keys, chunks, text, normal, starts`` of the covered beginning of each scene: chunks from 0 on without a gap that are all covered."""
    marked = chunks.join(covered.select(*keys, index).distinct(), [*keys, index], "left_semi")
    order = W.partitionBy(*keys).orderBy(index)
    # Within a beginning without gaps the place of a chunk is its index.
    prefix = marked.filter(F.col(index) >= 0).withColumn("_p", F.row_number().over(order) - 1).filter(F.col("_p") == F.col(index))
    sized = prefix.withColumn("_start", F.coalesce(F.sum(F.length(text)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct(index, F.col(text).alias("t"), "_start")))
    out = sized.groupBy(*keys).agg(F.count("*").alias("chunks"), listed.alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["t"]), "")
    return out.select(*keys, "chunks", joined.alias("text"), T.match_text(joined).alias("normal"), F.transform("_l", lambda x: x["_start"]).alias("starts"))


def messages_of(rows: DataFrame) -> DataFrame:
    """Add ``messages`` from ``messages`` or, where that is missing, from ``data.messages``."""
    names = {f.name for f in rows.schema.fields}
    sides = [F.col(c) for c, there in (("messages", "messages" in names), ("data.messages", "data" in names)) if there]
    return rows.withColumn("messages", F.coalesce(*sides))


def message_units(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, message_index, unit_index, kind, speaker, content`` of chat records with ``messages``: the system's go, a user's are read line by line, an unknown role raises."""
    each = messages_of(records).select(*keys, F.posexplode("messages").alias("message_index", "_m"))
    role = _raise_if(~F.coalesce(F.col("_m.role").isin(CHAT_ROLES), F.lit(False)), "unknown role:", F.to_json(F.struct(*keys)), F.col("_m.role"), value=F.col("_m.role"))
    spoken = each.withColumn("_role", role).filter("_role <> 'system'")
    body = F.coalesce(F.col("_m.content"), F.lit(""))
    lines = F.when(F.col("_role") == "user", F.split(body, "\r\n|\r|\n")).otherwise(F.array(body))
    units = spoken.select(*keys, "message_index", "_role", F.posexplode(lines).alias("unit_index", "_line")).filter(T.strip(F.col("_line")) != "")
    user = F.col("_role") == "user"
    parsed = T.parse_line(F.col("_line"))
    return units.select(*keys, "message_index", "unit_index", F.when(user, parsed["kind"]).otherwise("reply").alias("kind"), F.when(user, parsed["speaker"]).alias("speaker"), F.when(user, parsed["content"]).otherwise(F.col("_line")).alias("content"))


def covered_lines(lines: DataFrame, scenes: DataFrame, keys: Sequence[str], chunk: str) -> tuple[DataFrame, DataFrame]:
    """Lines of scenes that are covered up to the lines' chunk, and the others as issues.

    ``scenes`` has the keys and ``chunks``, the number of covered chunks.
    """
    joined = lines.join(scenes.select(*keys, "chunks"), list(keys), "left")
    inside = F.col("chunks").isNotNull() & F.coalesce(F.col(chunk) < F.col("chunks"), F.lit(False))
    why = F.when(F.col("chunks").isNull(), "the scene isn't covered").otherwise("the chunk lies behind the covered ones")
    return joined.filter(inside).drop("chunks"), issues(joined.filter(~inside), "not_covered", why, *keys, chunk)


def nested_dialogues(document: DataFrame) -> DataFrame:
    """``plot_index, line_index`` and the fields of each utterance of a document with ``plots`` of ``utterances``; a scene that occurs twice raises."""
    plots = document.select(F.explode("plots").alias("_p")).select("_p.*")
    counted = plots.withColumn("_n", F.count("*").over(W.partitionBy("plot_index")))
    single = _raise_if(F.col("_n") > 1, "two records of scene", F.col("plot_index"), value=F.col("utterances"))
    return counted.select("plot_index", F.posexplode(single).alias("line_index", "_u")).select("plot_index", "line_index", "_u.*")


def scene_messages(document: DataFrame) -> DataFrame:
    """``plot_index, message_index`` and the fields of each message of a document with ``plots`` of ``messages``; a scene that occurs twice raises."""
    plots = document.select(F.explode("plots").alias("_p")).select("_p.plot_index", "_p.messages")
    counted = plots.withColumn("_n", F.count("*").over(W.partitionBy("plot_index")))
    single = _raise_if(F.col("_n") > 1, "two records of scene", F.col("plot_index"), value=F.col("messages"))
    return counted.select("plot_index", F.posexplode(single).alias("message_index", "_m")).select("plot_index", "message_index", "_m.*")


def episode_sources(spark: SparkSession, pattern: str, schema: str, key: str, output: str | None = None) -> DataFrame:
    """``source, line`` and the fields of all matching files but the output's; a key that is missing or occurs twice anywhere raises."""
    rows = read_numbered(spark, pattern, schema)
    if output is not None:
        rows = rows.filter(~F.endswith(F.col("file"), F.lit(output.removeprefix("file:").lstrip("/"))))
    named = rows.select(F.element_at(F.split("file", "/"), -2).alias("source"), "line", "value.*")
    n = F.count("*").over(W.partitionBy(key))
    return named.withColumn(key, _raise_if(F.col(key).isNull() | (n > 1), "missing or repeated id:", F.col("source"), F.col("line"), value=F.col(key)))


def transition_document(groups: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, nodes: str) -> DataFrame:
    """``keys, document``: the changes of each scene as JSON, in order: an array of ``source`` and ``nodes``."""
    item = F.struct(*order, F.col(source).alias("_s"), F.col(nodes).alias("_n"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["_s"].alias("source"), x["_n"].alias("nodes")))
    return groups.groupBy(*keys).agg(F.to_json(listed).alias("document"))


# -- writers ---------------------------------------------------------------


def write_document(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    """A small JSON document as one file, whole or not at all."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and not overwrite:
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = system.create(part, True)
    stream.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")


def write_episodes(episodes: DataFrame, folder: str, key: str, overwrite: bool = False) -> int:
    """Episodes as JSON lines and, after they are read back and counted, a manifest; returns their number."""
    n = write_checked(episodes, f"{folder}/episodes", key, "overwrite" if overwrite else "errorifexists")
    write_document(episodes.sparkSession, f"{folder}/manifest.json", {"episodes": n}, overwrite)
    return n


def write_role_samples(samples: DataFrame, coverage: DataFrame, folder: str, keys: list[str], overwrite: bool = False) -> None:
    """Chat samples in one set and by character, and a manifest with the counts of each; an overwrite leaves no old character's files.

    ``coverage`` is one row with ``total``, ``covered`` and ``missing``, a list.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    rows = chat_rows(samples, keys, "target", "turn")
    name = F.coalesce(F.nullif(T.safe_filename(F.col("target")), F.lit("")), F.lit("character"))
    rows.select("messages").write.mode(mode).json(f"{folder}/all")
    rows.select("messages", name.alias("character")).write.mode(mode).partitionBy("character").json(f"{folder}/by_character")
    counts = rows.groupBy(F.col("target").alias("character")).agg(F.count("*").alias("samples"))
    counts.write.mode(mode).json(f"{folder}/characters")
    facts = coverage.first()
    total = counts.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("n")).first()["n"]
    write_document(samples.sparkSession, f"{folder}/manifest.json", {"samples": total, "chunks": facts["total"], "covered": facts["covered"], "missing": list(facts["missing"] or [])}, overwrite)


def write_reward_set(evaluation: DataFrame, mapping: DataFrame, unmatched: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """Evaluation rows, the mapping to their sources, what found no match, a description of the files, and counts."""
    mode = "overwrite" if overwrite else "errorifexists"
    counts = {}
    for name, df in (("evaluation", evaluation), ("mapping", mapping), ("unmatched", unmatched)):
        write_jsonl(df, f"{folder}/{name}", mode)
        counts[name] = df.sparkSession.read.text(f"{folder}/{name}").count()
    spark = evaluation.sparkSession
    write_document(spark, f"{folder}/dataset_info.json", {"evaluation": {"file_name": "evaluation", "columns": evaluation.columns}}, overwrite)
    write_document(spark, f"{folder}/statistics.json", counts, overwrite)
    return counts


def backup(spark: SparkSession, path: str, copy: str) -> None:
    """A copy of a file or folder; one that is there already raises."""
    if exists(spark, copy):
        raise FileExistsError(copy)
    jvm = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    a, b = jvm.Path(path), jvm.Path(copy)
    if not jvm.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"cannot copy {path}")


# -- tables of rows that change ----------------------------------------------


def apply_changes(rows: DataFrame, changes: DataFrame, keys: Sequence[str], deleted: str, order: str) -> DataFrame:
    """Rows after inserts, updates and deletes: of each key the last change counts, and one with ``deleted`` takes the row away."""
    last = changes.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_rn = 1")
    kept = rows.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*rows.columns))


def ordered_merge(first: DataFrame, second: DataFrame, keys: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """Both sides' rows with ``place`` from 0 in each group: by position, the first side before the second, rows without a position last."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.select(*first.columns).withColumn("side", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(position).asc_nulls_last(), "side", *order)) - 1
    return both.withColumn("place", place)


def appended_chunks(chunks: DataFrame, resources: DataFrame, resource: str, order: str, index: str) -> DataFrame:
    """Chunks of all resources with one running ``global_index`` from 0: resources in order, then chunks.

    The resources' sizes give the offsets, so no task holds all chunks.
    """
    sizes = chunks.groupBy(resource).agg(F.count("*").alias("_n")).join(resources.select(resource, order).distinct(), resource)
    # One row per resource.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(order, resource).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(resource, "_before")
    own = F.row_number().over(W.partitionBy(resource).orderBy(index)) - 1
    return chunks.withColumn("_own", own).join(before, resource).withColumn("global_index", F.col("_before") + F.col("_own")).drop("_own", "_before")


def first_units(units: DataFrame, order: Sequence[str], debug: bool, most: int = 5) -> DataFrame:
    """All units, or in a debug run the first few."""
    return units.orderBy(*order).limit(most) if debug else units


def expired(rows: DataFrame, finished: str, now: Column, seconds: int) -> DataFrame:
    """Rows that ended more than so many seconds ago; rows without an end never expire."""
    return rows.filter(F.col(finished) < now - F.make_dt_interval(secs=F.lit(seconds)))


def ocr_sentences(blocks: DataFrame, text: str) -> DataFrame:
    """Add ``sentence_index`` and ``sentence`` to blocks of recognised text: cut at sentence marks and semicolons, trimmed, empty ones left out."""
    return blocks.select("*", F.posexplode(T.trimmed_sentences(F.col(text), T.SENTENCE_ENDS + ";；")).alias("sentence_index", "sentence"))


def book_kind(pages: DataFrame, keys: Sequence[str], least_images: float = 0.3, most_text: int = 300) -> DataFrame:
    """``keys, images, text_chars, picture_book`` of books from pages with ``html``: few images for its pages, or much text on them, makes a text book."""
    plain = T.html_to_text(F.col("html"))
    facts = pages.groupBy(*keys).agg(F.count("*").alias("_pages"), F.sum(F.regexp_count("html", F.lit(r"(?i)<(?:img|image)\b"))).alias("images"), F.sum(F.length(plain)).alias("text_chars"))
    enough = F.coalesce(F.try_divide("images", "_pages") >= least_images, F.lit(False))
    return facts.select(*keys, "images", "text_chars", (enough & (F.col("text_chars") <= most_text)).alias("picture_book"))
