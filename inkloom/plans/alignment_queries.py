"""Queries of operators with a cursor: alignment and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import alignment as A
from inkloom.operators import scenes
from inkloom.plans.registry import query
from inkloom.plans.sequence_queries import chunks
from inkloom.session import table

KEYS = ["book_key", "plot_index"]


def _sides(spark, sf_dir):
    """All lines, and the text of every scene: its chunks in order, each once."""
    u = table(spark, sf_dir, "utterances").select("utterance_id", "conversation_id", "book_key", "plot_index", "utterance_index", "speaker", "content").distinct()
    p = table(spark, sf_dir, "plot_chunks").groupBy(*KEYS, "chunk_index").agg(F.min("text").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "")
    return u, p.groupBy(*KEYS).agg(whole.alias("text"))


@query()
def forward_align(spark, sf_dir):
    """Spans of the lines in their scene chunk, exact or by likeness, always forward."""
    u, p = _sides(spark, sf_dir)
    return A.forward_align(u, p, KEYS, ["conversation_id", "utterance_index", "utterance_id"], "utterance_id")


@query()
def bounded_align(spark, sf_dir):
    """Places of the lines by normal form: long ones first, short ones between them."""
    u, p = _sides(spark, sf_dir)
    return A.bounded_align(u, p, KEYS, ["conversation_id", "utterance_index", "utterance_id"], "utterance_id")


@query()
def expanding_locate(spark, sf_dir):
    """The source sentences of the lines."""
    u, p = _sides(spark, sf_dir)
    return A.expanding_locate(u, p, KEYS, ["conversation_id", "utterance_index", "utterance_id"], "utterance_id")


@query(r"""
    WITH o AS (SELECT DISTINCT plot_chunk_id, book_key, plot_index, chunk_index, unnest(range(len(source_refs))) AS piece, unnest(source_refs) AS r FROM plot_chunks)
    SELECT book_key, count(*) AS spans, sum(r.span_end - r.span_start)::BIGINT AS chars FROM o GROUP BY book_key""")
def span_totals(spark, sf_dir):
    """How much of its book a book's scenes refer to."""
    refs = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "book_key", "plot_index", "chunk_index", F.posexplode("source_refs").alias("piece", "r")).distinct()
    return refs.groupBy("book_key").agg(F.count("*").alias("spans"), F.sum(F.col("r.span_end") - F.col("r.span_start")).alias("chars"))


@query()
def plot_rebuild(spark, sf_dir):
    """Scenes of each book, from the first and last sentence of every other chunk's paragraphs as marks."""
    c = chunks(spark, sf_dir).filter("text is not null").groupBy("book_key", "chunk_index").agg(F.min_by(F.struct("text", "section"), "chunk_id").alias("x")).select("book_key", "chunk_index", "x.text", "x.section")
    s = T.split_sentences(F.col("text"), T.SENTENCE_ENDS + ".")
    first, last = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))
    # Chunks of one sentence have no marks; the others a scene from their second sentence on, which goes on where the text doesn't stop.
    stops = F.col("text").rlike(r"[.。！？!?”\"]\s*$")
    marks = F.when(F.size(s) > 1, F.array(F.struct(F.lit(None).cast("string").alias("start"), first.alias("end")), F.struct(F.try_element_at(s, F.lit(2)).alias("start"), F.when(stops & (F.size(s) > 2), last).alias("end"))))
    return scenes.rebuild_scenes(c.withColumn("marks", marks), ["book_key"], "chunk_index", "section", "marks")


@query()
def line_corrections(spark, sf_dir):
    """Lines of one scene chunk in two extractions: which of the later corrects which of the earlier."""
    u, _ = _sides(spark, sf_dir)
    form = u.filter((F.col("speaker") != T.NARRATOR) & F.col("content").isNotNull()).withColumn("form", T.match_text(F.col("content")))
    first = form.groupBy("book_key", "plot_index").agg(F.min("conversation_id").alias("first"))
    marked = form.join(first, ["book_key", "plot_index"])
    page = ["book_key", "plot_index", "utterance_index"]
    seen = marked.filter("conversation_id = first").select(*page, F.col("utterance_id").alias("seen_id"), "form")
    read = marked.filter("conversation_id <> first").select(*page, F.col("utterance_id").alias("read_id"), "form")
    return A.ocr_corrections(seen, read, page, "seen_id", "read_id")


@query()
def turn_matches(spark, sf_dir):
    """Which line of the dialogue each candidate's response is, by normal form and speaker, in order."""
    from inkloom.functions.similarity import normalized

    turns = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", "plot_index", "sft_line", "sft_message_index", F.col("character_name").alias("name"), normalized("reference_response").alias("form")).distinct().filter("form <> ''")
    lines = table(spark, sf_dir, "utterances").filter(F.col("speaker") != T.NARRATOR).select("utterance_id", "conversation_id", "book_key", "plot_index", "utterance_index", F.col("speaker").alias("name"), normalized("content").alias("form")).distinct().filter("form <> ''")
    keys = ["book_key", "plot_index"]
    return A.turn_matches(turns, lines, keys, ["sft_line", "sft_message_index", "candidate_id"], "candidate_id", ["conversation_id", "utterance_index", "utterance_id"], "utterance_id")


@query(r"""
    WITH a AS (SELECT DISTINCT utterance_id, book_key, plot_index, utterance_index, speaker, content FROM utterances WHERE content IS NOT NULL),
    p AS (SELECT DISTINCT book_key, plot_index, chunk_index, text FROM plot_chunks)
    SELECT a.utterance_id, count(*) FILTER (WHERE strpos(p.text, a.content) > 0) AS chunks, coalesce(sum(CASE WHEN a.content <> '' THEN len(string_split(p.text, a.content)) - 1 ELSE 0 END), 0)::BIGINT AS places
    FROM a JOIN p USING (book_key, plot_index) GROUP BY a.utterance_id""")
def source_presence(spark, sf_dir):
    """In how many chunks of its scene a line is found word for word, and how often; just once is a sure place."""
    a = table(spark, sf_dir, "utterances").filter("content is not null").select("utterance_id", "book_key", "plot_index", "content").distinct()
    p = table(spark, sf_dir, "plot_chunks").select("book_key", "plot_index", "chunk_index", "text").distinct()
    both = a.join(p, ["book_key", "plot_index"])
    shorter = F.length("text") - F.length(F.replace("text", F.col("content"), F.lit("")))
    places = F.when(F.col("content") != "", (shorter / F.length("content")).cast("bigint")).otherwise(0)
    return both.groupBy("utterance_id").agg(F.count_if(F.contains("text", "content")).alias("chunks"), F.coalesce(F.sum(places), F.lit(0)).alias("places"))
