"""From texts to chat samples: chunks, scenes, characters, dialogue, alignment, export.

Every stage is written to the output folder and read back, so that a stage can
be looked at, mended and taken up again.  The three model stages go through
``model_stage.run_stage`` with the client factories given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import alignment, chunking, names, relations, scenes
from inkloom.operators import sequence as S
from inkloom.plans.model_stage import Client, raise_failures, run_stage
from inkloom.sources import sinks

MARKS = "struct<characters: array<struct<names: array<string>, description: string, plot_indexes: array<int>>>, plots: array<struct<start: string, end: string>>, state: string>"
LINES = "struct<utterances: array<struct<speaker: string, content: string>>>"
PROFILE = "struct<name: string, content: string>"


@dataclass(frozen=True)
class Settings:
    """Budgets count code points."""

    chunk_budget: int = 5120
    scene_budget: int = 5120
    context_sentences: int = 3
    description_budget: int = 24_000
    attempts: int = 3
    ends: str = T.SENTENCE_ENDS


class TextDataset:
    """One build; ``resources`` has path, narrative_order and text."""

    def __init__(self, spark: SparkSession, resources: DataFrame, out: str, scene_client: Callable[[], Client], profile_client: Callable[[], Client], dialogue_client: Callable[[], Client], settings: Settings = Settings()):
        self.spark, self.resources, self.out, self.settings = spark, resources, out.rstrip("/"), settings
        self.clients = {"scenes": scene_client, "profiles": profile_client, "dialogue": dialogue_client}

    def artifact(self, name: str, df: DataFrame) -> DataFrame:
        """Write a stage and read it back."""
        df.write.mode("overwrite").parquet(f"{self.out}/work/{name}")
        return self.spark.read.parquet(f"{self.out}/work/{name}")

    def chunks(self) -> DataFrame:
        """``file, chunk_index, text, token_count, section``: sections cut into chunks, counted on through a file."""
        s = self.settings
        parts = chunking.split_sections(self.resources, ["path"], "text")
        packed = chunking.pack_sentences(parts.withColumnRenamed("body", "text"), ["path", "section_index", "volume", "chapter"], "text", s.chunk_budget, s.ends)
        at = F.row_number().over(S._ordered(["path"], ["section_index", "chunk_index"])) - 1
        section = F.concat_ws("|", F.coalesce("volume", F.lit("")), F.coalesce("chapter", F.lit("")), "section_index")
        return self.artifact("text_chunks", packed.select(F.col("path").alias("file"), at.alias("chunk_index"), "text", "token_count", section.alias("section")))

    def marked(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the model's characters and scene marks; an open scene is closed where its section ends."""
        s = self.settings
        sentences = T.split_sentences(F.col("text"), s.ends)
        near = S.adjacent_context(S.section_ends(chunks, ["file"], ["chunk_index"], F.col("section")), ["file"], ["chunk_index"], F.col("section"), sentences, s.context_sentences)
        request = F.to_json(F.struct(F.col("text").alias("input"), F.col("previous_context").alias("previous"), F.col("next_context").alias("next")))
        told = raise_failures(self.artifact("scene_results", run_stage(near.withColumn("request", request), "request", self.clients["scenes"], attempts=s.attempts)))
        found = told.withColumn("r", F.from_json("result", MARKS))
        last = F.try_element_at("r.plots", F.lit(-1))
        close = F.col("section_end") & (F.col("r.state") == "truncated") & last.isNotNull() & last["end"].isNull()
        closed = F.concat(F.slice("r.plots", 1, F.greatest(F.size("r.plots") - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.try_element_at(sentences, F.lit(-1)).alias("end"))))
        return found.select("file", "chunk_index", "text", "section", F.when(close, closed).otherwise(F.col("r.plots")).alias("marks"), F.col("r.characters").alias("characters"))

    def scene_chunks(self, marked: DataFrame) -> DataFrame:
        """``file, plot_index, chunk_index, text, refs``: scenes in chunks with the spans they come from."""
        pieces = scenes.rebuild_scenes(marked, ["file"], "chunk_index", "section", "marks")
        wrong = pieces.filter(F.col("error").isNotNull()).first()
        if wrong:
            raise scenes.BoundaryError(f"{wrong['file']}: {wrong['error']}")
        source = marked.select("file", F.col("chunk_index").alias("position"), F.col("text").alias("source"))
        parts = pieces.join(source, ["file", "position"]).withColumn("part", F.substring("source", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")))
        placed = self.artifact("pieces", S.offset_sums(parts.drop("source"), ["file", "scene"], ["piece"], F.length("part")))
        whole = placed.groupBy("file", "scene").agg(S.joined_in_order(["piece"], F.col("part"), "").alias("text"))
        cut = chunking.pack_sentences(whole, ["file", "scene"], "text", self.settings.scene_budget, self.settings.ends, crossing=False)
        spans = self.artifact("scene_spans", S.offset_sums(cut, ["file", "scene"], ["chunk_index"], F.length("text")))
        piece = F.struct("piece", "position", "span_start", "offset_start")
        over = relations.span_overlaps(spans.withColumnRenamed("chunk_index", "_c").select("file", "scene", "_c", "offset_start", "offset_end"), placed.select("file", "scene", piece.alias("_p"), "offset_start", "offset_end"), ["file", "scene"], "offset_start", "offset_end", "_c", "_p")
        start = F.col("_p.span_start") + F.col("start") - F.col("_p.offset_start")
        ref = F.struct(F.col("_p.piece").alias("piece"), F.col("_p.position").alias("chunk_index"), start.cast("int").alias("span_start"), (start + F.col("end") - F.col("start")).cast("int").alias("span_end"))
        refs = over.groupBy("file", "scene", F.col("_c").alias("chunk_index")).agg(F.array_sort(F.collect_list(ref)).alias("refs"))
        return self.artifact("plot_chunks", spans.join(refs, ["file", "scene", "chunk_index"]).select("file", F.col("scene").alias("plot_index"), "chunk_index", "text", "refs"))

    def characters(self, marked: DataFrame) -> DataFrame:
        """``file, group, name, names, profile``: grouped candidates with the name and profile the model gives; the name must be one of the group's."""
        each = marked.select("file", "chunk_index", F.posexplode("characters").alias("_i", "c")).select("file", (F.col("chunk_index").cast("bigint") * 10_000 + F.col("_i")).alias("at"), T.safe_names(F.col("c.names")).alias("names"), "c.description")
        kept = self.artifact("candidates", each.filter(F.size("names") > 0))
        groups = names.materialised_groups(kept, "file", "at", "names")
        summaries = names.group_summaries(kept, groups, "file", "at", "names", "description", self.settings.description_budget)
        request = F.to_json(F.struct("names", "description"))
        told = raise_failures(self.artifact("profile_results", run_stage(summaries.select("file", "group", "names", request.alias("request")), "request", self.clients["profiles"], attempts=self.settings.attempts)))
        found = told.withColumn("r", F.from_json("result", PROFILE))
        name = F.when(F.array_contains("names", F.col("r.name")), F.col("r.name")).otherwise(F.raise_error(F.concat(F.lit("not a name of its group: "), F.coalesce("r.name", F.lit("null")))))
        return self.artifact("characters", found.select("file", "group", name.alias("name"), "names", F.col("r.content").alias("profile")))

    def utterances(self, plot_chunks: DataFrame, characters: DataFrame) -> DataFrame:
        """Lines of every scene in order, under canonical names, with their spans in the scene chunk."""
        request = F.to_json(F.struct(F.col("text").alias("input"), "plot_index", "chunk_index"))
        told = raise_failures(self.artifact("dialogue_results", run_stage(plot_chunks.select("file", "plot_index", "chunk_index", "text", request.alias("request")), "request", self.clients["dialogue"], attempts=self.settings.attempts)))
        raw = told.select("file", "plot_index", "chunk_index", F.posexplode(F.from_json("result", LINES)["utterances"]).alias("place", "u")).select("file", "plot_index", "chunk_index", "place", "u.speaker", "u.content")
        aliases = characters.select("file", "name", F.explode("names").alias("alias"))
        named = relations.canonical(raw, aliases, ["file"], "speaker", "alias", "name")
        index = F.row_number().over(S._ordered(["file", "plot_index"], ["chunk_index", "place"])) - 1
        numbered = named.withColumn("utterance_index", index).withColumn("line_id", F.xxhash64("file", "plot_index", "utterance_index"))
        lines = self.artifact("lines", numbered)
        spans = alignment.forward_align(lines, plot_chunks, ["file", "plot_index", "chunk_index"], ["place"], "line_id")
        return self.artifact("utterances", lines.join(spans, "line_id", "left").drop("line_id"))

    def build(self) -> DataFrame:
        """Run all stages and write the chat samples; returns the samples."""
        chunks = self.chunks()
        marked = self.artifact("marked", self.marked(chunks))
        plot_chunks, characters = self.scene_chunks(marked), self.characters(marked)
        lines = self.utterances(plot_chunks, characters)
        samples = self.artifact("samples", S.role_samples(lines, ["file", "plot_index"], ["utterance_index"]))
        sinks.write_chat(samples, f"{self.out}/exports/chat", ["file", "plot_index"])
        sinks.write_profiles(characters.select("name", "profile"), f"{self.out}/characters")
        return samples
