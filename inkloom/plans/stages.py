"""The model stages beside the text build: blocks of dialogue, states, tasks, and the stages of picture books.

Every stage makes requests as JSON, sends them through ``run_stage`` and reads
the answers into rows; what an answer must hold is checked inside the attempt,
so a bad one is asked for again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators import records
from inkloom.operators import sequence as S
from inkloom.plans.model_stage import Client, ask, paced, run_stage, with_feedback

LINES = "utterances array<struct<speaker: string, content: string>>"
NODES = "array<struct<name: string, before: string, after: string, source: string>>"
TASKS = "plot string, tasks array<struct<name: string, values: array<string>>>"
PAGES = "utterances array<struct<page_index: int, speaker: string, content: string>>, characters array<struct<character_index: string, names: array<string>, description: string>>, chapter_starts array<int>, plot string"
CATALOGUE = "characters array<struct<name: string, aliases: array<string>, description: string>>"
ASSIGNED = "assignments array<struct<observation: string, name: string>>"
PROFILE = "name string, content string"

#: Attributes that later chunks are told of from all earlier ones.
CARRIED = (".active", ".location")


def _list_of(name: str, *fields: str) -> Callable[[object], object]:
    """A check that a result is an object whose ``name`` is a list of objects with these fields, none of them blank."""

    def check(value):
        items = value.get(name) if isinstance(value, dict) else None
        if not isinstance(items, list):
            raise ValueError(f"{name} isn't a list")
        for i, item in enumerate(items):
            wrong = [f for f in fields if not isinstance(item, dict) or item.get(f) is None or not str(item[f]).strip()]
            if wrong:
                raise ValueError(f"{name}[{i}] lacks {', '.join(wrong)}")
        return value

    return check


def _told(units: DataFrame, request: Column, make: Callable[[], Client], check: Callable[[object], object], schema: str, attempts: int) -> DataFrame:
    told = run_stage(units.drop("result", "error", "attempts", "told").withColumn("request", F.to_json(request)), "request", make, check, attempts, again=with_feedback)
    return told.withColumn("told", F.from_json("result", schema)).drop("request")


def dialogue_blocks(chunks: DataFrame, characters: DataFrame, make: Callable[[], Client], keys: Sequence[str] = ("file", "plot_index"), size: int = 4, attempts: int = 3) -> DataFrame:
    """Blocks of successive chunks of a scene with the lines ``told``; a scene's first block asks for an opening.

    ``characters`` has the first key and ``names``; all of a file's are told.
    """
    cast = characters.groupBy(keys[0]).agg(F.array_sort(F.collect_list("names")).alias("cast"))
    numbered = chunks.withColumn("block", F.expr(f"chunk_index div {size}"))
    blocks = numbered.groupBy(*keys, "block").agg(S.joined_in_order(["chunk_index"], F.col("text"), "").alias("input"))
    request = F.struct("input", F.coalesce("cast", F.array().cast("array<array<string>>")).alias("characters"), (F.col("block") == 0).alias("opening"))
    return _told(blocks.join(cast, keys[0], "left"), request, make, _list_of("utterances", "speaker", "content"), LINES, attempts).drop("cast")


def extract_states(chunks: DataFrame, make: Callable[[], Client], keys: Sequence[str] = ("file", "plot_index"), attempts: int = 3, per_second: float | None = None) -> DataFrame:
    """``keys, chunk_index, result, error, attempts``: the state changes of each chunk, one after the other inside a scene.

    A chunk is told the last values of the carried attributes from all chunks
    before, and every node of the chunk before.  Where a chunk fails, or is
    missing, the rest of its scene isn't asked for and says so; other scenes go
    on.  The order inside a scene is the algorithm, so a scene is one task's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    check = _list_of("nodes", "name")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        client, before = make(), paced(per_second)
        frame = frame.sort_values("chunk_index", kind="stable")
        held: dict[str, dict] = {}
        last: list[dict] = []
        stopped, out = None, []
        for want, (at, text) in enumerate(zip(frame["chunk_index"], frame["text"])):
            if stopped is None and at != want:
                stopped = f"chunk {want} is missing"
            if stopped is not None:
                out.append((at, None, stopped, 0))
                continue
            names = {n["name"] for n in last}
            told = [n for name, n in held.items() if name not in names] + last
            result, error, n = ask(client, json.dumps({"input": text, "prenodes": told}, ensure_ascii=False), check, attempts, before, with_feedback)
            out.append((at, result, error, n))
            if result is None:
                stopped = f"chunk {at} failed"
                continue
            last = json.loads(result)["nodes"]
            held.update({n["name"]: n for n in last if n["name"].endswith(CARRIED)})
        done = pd.DataFrame(out, columns=["chunk_index", "result", "error", "attempts"])
        for k in keys:
            done.insert(0, k, frame[k].iloc[0])
        return done[[*keys, "chunk_index", "result", "error", "attempts"]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "chunk_index"]) + ", result string, error string, attempts int"
    return chunks.select(*keys, "chunk_index", "text").groupBy(*keys).applyInPandas(run, schema)


def extract_tasks(scenes: DataFrame, make: Callable[[], Client], attempts: int = 3) -> DataFrame:
    """Scenes with ``input`` and ``characters`` (arrays of names), and their ``told`` summary and tasks."""

    def check(value):
        for task in _list_of("tasks", "name")(value)["tasks"]:
            values = task.get("values")
            if not isinstance(values, list) or not values or len(set(values)) < len(values) or not all(isinstance(v, str) and v.strip() for v in values):
                raise ValueError(f"{task['name']} has empty or repeated values")
        if len({t["name"] for t in value["tasks"]}) < len(value["tasks"]):
            raise ValueError("a name has two tasks")
        return value

    return _told(scenes, F.struct("input", "characters"), make, check, TASKS, attempts)


# -- picture books -----------------------------------------------------------


def read_pages(batches: DataFrame, make: Callable[[], Client], attempts: int = 2) -> DataFrame:
    """Batches with an array of ``pages``, and what is ``told`` of them."""
    return _told(batches, F.struct("pages"), make, _list_of("utterances", "content"), PAGES, attempts)


def page_lines(told: DataFrame, batch: str, first: str, last: str) -> DataFrame:
    """The lines of all batches in order with ``problem``: a page outside the batch, a speaker that isn't one of its characters or is one twice."""
    lines = told.select(batch, F.posexplode("told.utterances").alias("place", "u")).select(batch, "place", "u.*")
    cast = told.select(batch, F.explode("told.characters").alias("c")).select(batch, "c.character_index")
    return records.visual_problems(lines, told.select(batch, F.col(first).alias("first_page"), F.col(last).alias("last_page")), cast, batch)


def catalogue(observations: DataFrame, book: str, make: Callable[[], Client], attempts: int = 2) -> DataFrame:
    """The characters of each book, one row each, from the names and descriptions of all observations."""
    item = F.struct("observation", "names", "description")
    books = observations.groupBy(book).agg(F.array_sort(F.collect_list(item)).alias("observations"))
    return _told(books, F.struct("observations"), make, _list_of("characters", "name"), CATALOGUE, attempts).select(book, "error", F.explode_outer("told.characters").alias("c")).select(book, "error", "c.*")


def assign_observations(observations: DataFrame, characters: DataFrame, book: str, make: Callable[[], Client], budget: int, attempts: int = 2) -> DataFrame:
    """``book, observation, name``: the catalogue's name of each observation, asked for in groups whose JSON fits the budget; an answer without an observation leaves its name null."""
    sized = observations.withColumn("_item", F.struct("observation", "names", "description")).withColumn("_size", F.length(F.to_json("_item")))
    packs = records.budget_groups(sized, [book], "observation", F.col("_size"), budget)
    known = characters.groupBy(book).agg(F.array_sort(F.collect_list("name")).alias("catalogue"))
    groups = sized.join(packs, [book, "observation"]).groupBy(book, "pack").agg(F.array_sort(F.collect_list("_item")).alias("observations")).join(known, book)
    told = _told(groups, F.struct("catalogue", "observations"), make, _list_of("assignments", "observation", "name"), ASSIGNED, attempts)
    each = told.select(book, F.explode("told.assignments").alias("a")).select(book, F.col("a.observation").alias("observation"), F.col("a.name").alias("_name"))
    once = each.join(characters.select(book, F.col("name").alias("_name")), [book, "_name"]).groupBy(book, "observation").agg(F.min("_name").alias("name"), F.count_distinct("_name").alias("_n"))
    single = once.select(book, "observation", F.when(F.col("_n") == 1, F.col("name")).alias("name"))
    return observations.select(book, F.col("observation").cast("string").alias("observation")).join(single, [book, "observation"], "left")


def revise_lines(chapters: DataFrame, make: Callable[[], Client], attempts: int = 2) -> DataFrame:
    """Chapters with ``plot``, ``characters`` and ``lines``, and the ``told`` lines."""
    return _told(chapters, F.struct("plot", "characters", "lines"), make, _list_of("utterances", "speaker", "content"), LINES, attempts)


def describe_characters(characters: DataFrame, lines: DataFrame, keys: Sequence[str], make: Callable[[], Client], attempts: int = 2) -> DataFrame:
    """The characters that speak somewhere, with ``name``, ``aliases`` and ``description``, and the profile ``told``."""

    def check(value):
        if not isinstance(value, dict) or not str(value.get("content") or "").strip():
            raise ValueError("an empty profile")
        return value

    used = characters.join(lines.select(*keys, F.col("speaker").alias("name")).distinct(), [*keys, "name"], "left_semi")
    return _told(used, F.struct("name", "aliases", "description"), make, check, PROFILE, attempts)
