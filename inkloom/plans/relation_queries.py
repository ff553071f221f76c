"""Queries of joins, aggregations, set operations, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import text as T
from inkloom.operators import alignment as A
from inkloom.operators import names as N
from inkloom.operators import ranking as R
from inkloom.operators import relations as J
from inkloom.operators import sequence as S
from inkloom.plans.registry import query
from inkloom.plans.sequence_queries import _CHUNKS, _LINES, chunks, lines
from inkloom.session import table
from inkloom.sources import datasets as D

_OBS = "(SELECT DISTINCT observation_id, book_key, names, description, plot_indexes FROM character_candidates)"
#: Candidate names clustered per book, by the least observation reachable over shared names.
_GROUPS = f"""
    o AS (SELECT DISTINCT observation_id, book_key, names FROM {_OBS}),
    e AS (SELECT DISTINCT book_key, observation_id AS id, unnest(names) AS n FROM o),
    l AS (SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y ON x.book_key = y.book_key AND x.n = y.n),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    g AS (SELECT o.book_key, o.observation_id, coalesce(min(r.b), o.observation_id) AS grp FROM o LEFT JOIN r ON r.a = o.observation_id GROUP BY o.book_key, o.observation_id)"""


def observations(spark, sf_dir):
    """Observations once each."""
    return table(spark, sf_dir, "character_candidates").select("observation_id", "book_key", "names", "description", "plot_indexes").distinct()


@query("""
    WITH r AS (SELECT DISTINCT plot_chunk_id, unnest(source_refs) AS r FROM plot_chunks), a AS (SELECT DISTINCT r.path AS file, r.chunk_index AS chunk_index FROM r),
    c AS (SELECT DISTINCT file, chunk_index FROM text_chunks)
    SELECT coalesce(a.file, c.file) AS file, CASE WHEN a.file IS NOT NULL AND c.file IS NOT NULL THEN 'both' WHEN a.file IS NOT NULL THEN 'left' ELSE 'right' END AS side, count(*) AS n
    FROM a FULL JOIN c ON a.file = c.file AND a.chunk_index = c.chunk_index GROUP BY 1, 2""")
def strict_zip(spark, sf_dir):
    """Chunks that scenes refer to against the chunks there are."""
    used = table(spark, sf_dir, "plot_chunks").select(F.explode("source_refs").alias("r")).select(F.col("r.path").alias("file"), "r.chunk_index").distinct()
    there = table(spark, sf_dir, "text_chunks").select("file", "chunk_index").distinct()
    return J.strict_zip(used, there, ["file", "chunk_index"]).groupBy("file", "side").agg(F.count("*").alias("n"))


@query("""
    WITH p AS (SELECT DISTINCT plot_chunk_id, text, source_refs FROM plot_chunks),
    r AS (SELECT plot_chunk_id, unnest(range(len(source_refs))) AS pos, unnest(source_refs) AS r FROM p),
    c AS (SELECT DISTINCT file, chunk_index, text FROM text_chunks),
    j AS (SELECT plot_chunk_id, string_agg(substr(c.text, r.span_start + 1, r.span_end - r.span_start), '' ORDER BY pos) AS joined, count(*) AS spans FROM r JOIN c ON c.file = r.path AND c.chunk_index = r.chunk_index GROUP BY 1)
    SELECT p.plot_chunk_id, coalesce(spans, 0) AS spans, coalesce(joined = p.text, false) AS same_text FROM (SELECT DISTINCT plot_chunk_id, text FROM p) p LEFT JOIN j USING (plot_chunk_id)""")
def span_texts(spark, sf_dir):
    """Whether the spans of a scene chunk, joined, give its text."""
    p = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "text", "source_refs").distinct()
    refs = p.select("plot_chunk_id", F.posexplode("source_refs").alias("pos", "r")).select("plot_chunk_id", "pos", F.col("r.path").alias("file"), "r.chunk_index", "r.span_start", "r.span_end")
    c = table(spark, sf_dir, "text_chunks").select("file", "chunk_index", F.col("text").alias("source")).distinct()
    parts = refs.join(c, ["file", "chunk_index"]).select("plot_chunk_id", "pos", F.substring("source", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("part"))
    joined = parts.groupBy("plot_chunk_id").agg(S.joined_in_order(["pos"], F.col("part"), "").alias("joined"), F.count("*").alias("spans"))
    out = p.select("plot_chunk_id", "text").distinct().join(joined, "plot_chunk_id", "left")
    return out.select("plot_chunk_id", F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"), F.coalesce(F.col("joined") == F.col("text"), F.lit(False)).alias("same_text"))


@query(f"""
    WITH RECURSIVE {_GROUPS}
    SELECT book_key, observation_id, grp AS "group" FROM g""")
def alias_groups(spark, sf_dir):
    """Observations of a book grouped over shared names."""
    return N.alias_groups(observations(spark, sf_dir), "book_key", "observation_id", "names")


@query(f"""
    WITH RECURSIVE {_GROUPS},
    d AS (SELECT g.book_key, g.grp, g.observation_id, x.description FROM g JOIN {_OBS} x ON x.observation_id = g.observation_id),
    f AS (SELECT book_key, grp, description, min(observation_id) AS first FROM d WHERE description IS NOT NULL AND description <> '' GROUP BY ALL),
    t AS (SELECT book_key, grp, string_agg(description, chr(10) ORDER BY first) AS t FROM f GROUP BY ALL),
    k AS (SELECT book_key, count(DISTINCT grp) AS n FROM g GROUP BY 1),
    m AS (SELECT book_key, grp, count(*) AS members, arg_max(description, (length(description), -observation_id)) AS longest FROM d GROUP BY ALL)
    SELECT m.book_key, m.grp AS "group", coalesce(substr(t.t, 1, (24000 // k.n)::INT), '') AS description, m.longest, m.members FROM m JOIN k USING (book_key) LEFT JOIN t USING (book_key, grp)""")
def budgeted_descriptions(spark, sf_dir):
    """Descriptions of each group within its share of 24,000 code points, and the longest one."""
    obs = observations(spark, sf_dir)
    out = N.group_summaries(obs, N.materialised_groups(obs, "book_key", "observation_id", "names"), "book_key", "observation_id", "names", "description", 24000)
    return out.select("book_key", "group", "description", "longest", "members")


@query(f"""
    WITH RECURSIVE {_GROUPS},
    x AS (SELECT g.book_key, g.grp, g.observation_id, unnest(range(len(o.names))) AS pos, unnest(o.names) AS name FROM g JOIN o ON o.observation_id = g.observation_id),
    c AS (SELECT book_key, grp, name, count(*) AS n, min((observation_id, pos)) AS first FROM x WHERE name IS NOT NULL GROUP BY ALL)
    SELECT book_key, grp AS "group", name, n, (row_number() OVER (PARTITION BY book_key, grp ORDER BY n DESC, first))::INT AS place FROM c""")
def name_frequencies(spark, sf_dir):
    """Names of each group by frequency, the canonical one first."""
    obs = observations(spark, sf_dir)
    groups = N.materialised_groups(obs, "book_key", "observation_id", "names")
    return N.name_frequencies(obs.join(groups, ["book_key", "observation_id"]), "book_key", "group", "observation_id", "names")


@query()
def conservative_groups(spark, sf_dir):
    """Observations grouped in order, ambiguous ones left out."""
    return N.conservative_groups(observations(spark, sf_dir), "book_key", "observation_id", "names")


@query(f"""
    WITH e AS (SELECT DISTINCT book_key, names[1] AS name, unnest(names) AS alias FROM {_OBS} WHERE len(names) > 0)
    SELECT book_key, alias, min(name) AS name FROM e WHERE alias IS NOT NULL GROUP BY book_key, alias HAVING count(DISTINCT name) = 1""")
def unique_aliases(spark, sf_dir):
    """Aliases that stand for one name in a book."""
    obs = observations(spark, sf_dir).filter(F.size("names") > 0).withColumn("name", F.col("names")[0])
    return N.unique_aliases(obs, "book_key", "name", "names")


@query(f"""
    WITH e AS (SELECT book_key, trim(names[1]) AS name, trim(unnest(names)) AS alias FROM {_OBS} WHERE len(names) > 0),
    k AS (SELECT * FROM e WHERE name <> '' AND lower(name) NOT IN ('unknown', '未知'))
    SELECT book_key, name, coalesce(string_agg(DISTINCT alias, '|' ORDER BY alias) FILTER (WHERE alias <> '' AND alias <> name), '') AS aliases FROM k GROUP BY book_key, name""")
def merged_catalogue(spark, sf_dir):
    """Entries of one first name merged, with their aliases."""
    obs = observations(spark, sf_dir).filter(F.size("names") > 0).withColumn("name", F.col("names")[0])
    out = N.merge_catalogue(obs, "book_key", "name", "names")
    return out.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""
    WITH u AS (SELECT DISTINCT utterance_id, book_key, speaker FROM utterances),
    a AS (SELECT DISTINCT observation_id, book_key, names[1] AS name, unnest(names) AS alias FROM {_OBS} WHERE len(names) > 0),
    m AS (SELECT book_key, alias, arg_max(name, (observation_id, name)) AS name FROM a WHERE name IS NOT NULL GROUP BY ALL)
    SELECT u.utterance_id, coalesce(m.name, u.speaker) AS speaker FROM u LEFT JOIN m ON u.book_key = m.book_key AND u.speaker = m.alias""")
def canonical_speakers(spark, sf_dir):
    """Speakers under the first name of the last observation that knows them."""
    rows = table(spark, sf_dir, "utterances").select("utterance_id", "book_key", "speaker").distinct()
    a = observations(spark, sf_dir).filter(F.size("names") > 0).select("observation_id", "book_key", F.col("names")[0].alias("name"), F.explode("names").alias("alias")).filter("name is not null")
    return J.canonical(rows, a, ["book_key"], "speaker", "alias", "name", ["observation_id"]).select("utterance_id", "speaker")


@query(f"""
    WITH p AS (SELECT DISTINCT book_key, plot_index FROM plot_chunks),
    o AS (SELECT observation_id, book_key, unnest(plot_indexes) AS plot_index FROM {_OBS} WHERE plot_indexes IS NOT NULL),
    n AS (SELECT observation_id, book_key FROM {_OBS} WHERE plot_indexes IS NULL),
    x AS (SELECT p.book_key, p.plot_index, o.observation_id FROM p JOIN o ON o.book_key = p.book_key AND o.plot_index = p.plot_index UNION SELECT p.book_key, p.plot_index, n.observation_id FROM p JOIN n USING (book_key))
    SELECT book_key, plot_index, count(*) AS characters, min(observation_id) AS first_character FROM x GROUP BY ALL""")
def plot_characters(spark, sf_dir):
    """Characters of each scene; an observation without indexes is in all scenes of its book."""
    plots = table(spark, sf_dir, "plot_chunks").select("book_key", "plot_index").distinct()
    obs = observations(spark, sf_dir)
    named = obs.filter("plot_indexes is not null").select("observation_id", "book_key", F.explode("plot_indexes").alias("plot_index"))
    everywhere = obs.filter("plot_indexes is null").select("observation_id", "book_key")
    both = plots.join(named, ["book_key", "plot_index"]).unionByName(plots.join(everywhere, "book_key")).distinct()
    return both.groupBy("book_key", "plot_index").agg(F.count("*").alias("characters"), F.min("observation_id").alias("first_character"))


@query("""
    WITH r AS (SELECT DISTINCT plot_chunk_id, book_key, plot_index, unnest(source_refs) AS r FROM plot_chunks),
    s AS (SELECT plot_chunk_id, book_key, plot_index, r.chunk_index AS chunk_index, r.span_start AS s, r.span_end AS e FROM r)
    SELECT a.plot_chunk_id AS id_a, b.plot_chunk_id AS id_b, a.chunk_index AS chunk_index, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end"
    FROM s a JOIN s b ON a.book_key = b.book_key AND a.chunk_index = b.chunk_index AND a.plot_index < b.plot_index AND a.s < b.e AND b.s < a.e""")
def span_overlaps(spark, sf_dir):
    """Spans of the same chunk that different scenes share."""
    refs = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "book_key", "plot_index", F.explode("source_refs").alias("r")).distinct()
    s = refs.select("plot_chunk_id", "book_key", "plot_index", "r.chunk_index", F.col("r.span_start").alias("s"), F.col("r.span_end").alias("e"))
    a, b = s.select("book_key", "chunk_index", F.struct("plot_chunk_id", "plot_index").alias("a"), "s", "e"), s.select("book_key", "chunk_index", F.struct("plot_chunk_id", "plot_index").alias("b"), "s", "e")
    over = J.span_overlaps(a, b, ["book_key", "chunk_index"], "s", "e", "a", "b").filter("a.plot_index < b.plot_index")
    return over.select(F.col("a.plot_chunk_id").alias("id_a"), F.col("b.plot_chunk_id").alias("id_b"), "chunk_index", "start", "end")


@query(f"""
    WITH c AS (SELECT book_key, chunk_id, (sum(length(text)) OVER (PARTITION BY book_key ORDER BY chunk_index, chunk_id) - length(text))::BIGINT AS start FROM {_CHUNKS}),
    p AS (SELECT plot_chunk_id, book_key, (plot_index * 1000)::BIGINT AS place FROM (SELECT DISTINCT plot_chunk_id, book_key, plot_index FROM plot_chunks) WHERE plot_index IS NOT NULL)
    SELECT p.plot_chunk_id, c.chunk_id FROM p ASOF JOIN c ON p.book_key = c.book_key AND p.place >= c.start""")
def place_of(spark, sf_dir):
    """The chunk in which a place of the whole book lies."""
    c = S.offset_sums(chunks(spark, sf_dir).filter("text is not null"), ["book_key"], ["chunk_index", "chunk_id"], F.length("text"))
    p = table(spark, sf_dir, "plot_chunks").filter("plot_index is not null").select("plot_chunk_id", "book_key", (F.col("plot_index") * 1000).cast("bigint").alias("place")).distinct()
    out = J.place_of(p, c, ["book_key"], "place", "offset_start", "chunk_id")
    return out.filter("chunk_id is not null").select("plot_chunk_id", "chunk_id")


@query("""
    WITH u AS (SELECT DISTINCT book_key, stage FROM (SELECT DISTINCT book_key FROM text_resources), (SELECT DISTINCT stage FROM llm_outputs)),
    g AS (SELECT DISTINCT book_key, stage FROM llm_outputs WHERE content IS NOT NULL)
    SELECT u.book_key, u.stage FROM u LEFT JOIN g ON u.book_key = g.book_key AND u.stage = g.stage WHERE g.stage IS NULL""")
def pending_units(spark, sf_dir):
    """Books and stages that have no good output yet."""
    books = table(spark, sf_dir, "text_resources").select("book_key").distinct()
    outputs = table(spark, sf_dir, "llm_outputs").select("book_key", "stage", "content")
    stages = outputs.select(F.col("stage")).distinct().agg(F.collect_set("stage").alias("stages"))  # a handful of stage names
    units = books.join(F.broadcast(stages)).select("book_key", F.explode("stages").alias("stage"))
    return J.pending(units, outputs, ["book_key", "stage"], "content")


@query("""
    WITH a AS (SELECT DISTINCT book_key, plot_index FROM plot_chunks), b AS (SELECT DISTINCT book_key, plot_index FROM utterances)
    SELECT book_key, plot_index, 'missing' AS status FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.book_key = a.book_key AND b.plot_index = a.plot_index)
    UNION ALL SELECT book_key, plot_index, 'extra' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.book_key = b.book_key AND a.plot_index = b.plot_index)""")
def set_report(spark, sf_dir):
    """Scenes without dialogue, and dialogue without a scene."""
    return J.set_report(table(spark, sf_dir, "plot_chunks"), table(spark, sf_dir, "utterances"), ["book_key", "plot_index"])


@query("""
    WITH t AS (SELECT DISTINCT book_key, chunk_index FROM text_chunks), r AS (SELECT DISTINCT book_key, unnest(source_refs).chunk_index AS chunk_index FROM plot_chunks)
    SELECT t.book_key, count(*) AS total, count(r.chunk_index) AS covered, count(r.chunk_index) / count(*)::DOUBLE AS coverage FROM t LEFT JOIN r ON t.book_key = r.book_key AND t.chunk_index = r.chunk_index GROUP BY t.book_key""")
def coverage(spark, sf_dir):
    """The share of each book's chunks that scenes cover."""
    covered = table(spark, sf_dir, "plot_chunks").select("book_key", F.explode("source_refs").alias("r")).select("book_key", "r.chunk_index")
    return J.coverage(table(spark, sf_dir, "text_chunks"), covered, ["book_key"], "chunk_index")


@query("SELECT file, chunk_index, count(*) AS n FROM text_chunks GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Names of chunks that occur more than once."""
    return J.duplicate_keys(table(spark, sf_dir, "text_chunks"), ["file", "chunk_index"])


_NORMAL = "lower(regexp_replace({}, '[ \\t\\n\\r\\x{{3000}}\\p{{P}}]+', '', 'g'))"


@query(f"""
    WITH RECURSIVE l AS (SELECT DISTINCT utterance_id, conversation_id AS r, book_key AS b, utterance_index AS i, speaker, {_NORMAL.format('content')} AS t FROM utterances WHERE speaker <> 'Environment'),
    f AS (SELECT r, b, min(speaker) AS who FROM l GROUP BY ALL),
    a AS (SELECT r, b, t, speaker = who AS target, row_number() OVER (PARTITION BY r, b ORDER BY i, utterance_id) AS k FROM l JOIN f USING (r, b) WHERE length(t) >= 4),
    s AS (SELECT book_key AS b, plot_index AS p, {_NORMAL.format("string_agg(text, '' ORDER BY chunk_index)")} AS x FROM (SELECT book_key, plot_index, chunk_index, min(text) AS text FROM plot_chunks GROUP BY ALL) GROUP BY ALL),
    pairs AS (SELECT DISTINCT a.r, a.b, s.p FROM a JOIN s ON a.b = s.b AND strpos(s.x, a.t) > 0),
    walk AS (
        SELECT r, b, p, 0 AS k, 0 AS cur, 0 AS chars, 0 AS n, 0 AS bonus FROM pairs
        UNION ALL
        SELECT w.r, w.b, w.p, a.k::INT, CASE WHEN strpos(substr(s.x, w.cur + 1), a.t) > 0 THEN w.cur + strpos(substr(s.x, w.cur + 1), a.t) - 1 + length(a.t) ELSE w.cur END,
            w.chars + CASE WHEN strpos(substr(s.x, w.cur + 1), a.t) > 0 THEN length(a.t) ELSE 0 END, w.n + CASE WHEN strpos(substr(s.x, w.cur + 1), a.t) > 0 THEN 1 ELSE 0 END,
            w.bonus + CASE WHEN strpos(substr(s.x, w.cur + 1), a.t) > 0 AND a.target THEN 10 ELSE 0 END
        FROM walk w JOIN a ON a.r = w.r AND a.b = w.b AND a.k = w.k + 1 JOIN s ON s.b = w.b AND s.p = w.p),
    total AS (SELECT r, b, sum(length(t)) AS chars, max(k) AS k FROM a GROUP BY ALL),
    scored AS (SELECT w.r, w.b, w.p, w.chars + w.bonus AS score, w.chars / total.chars::DOUBLE AS coverage, w.n FROM walk w JOIN total ON w.r = total.r AND w.b = total.b AND w.k = total.k),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY r, b ORDER BY score DESC, coverage DESC, p) AS rn, lead(score) OVER (PARTITION BY r, b ORDER BY score DESC, coverage DESC, p) AS nxt FROM scored)
    SELECT r AS conversation_id, b AS book_key, p AS plot_index, score::BIGINT AS score, coverage, n::BIGINT AS anchors FROM ranked WHERE rn = 1 AND score >= 20 AND n >= 2 AND coverage >= 0.45 AND (nxt IS NULL OR nxt < score - 5)""")
def plot_choice(spark, sf_dir):
    """The scene that holds a conversation's strong lines one after the other, unless another holds nearly as many."""
    lines = table(spark, sf_dir, "utterances").filter(F.col("speaker") != T.NARRATOR).select("utterance_id", "conversation_id", "book_key", "utterance_index", "speaker", T.match_text(F.col("content")).alias("anchor")).distinct()
    first = lines.groupBy("conversation_id", "book_key").agg(F.min("speaker").alias("_who"))
    anchors = lines.join(first, ["conversation_id", "book_key"]).withColumn("target", F.col("speaker") == F.col("_who")).filter(F.length("anchor") >= 4)
    chunks = table(spark, sf_dir, "plot_chunks").groupBy("book_key", "plot_index", "chunk_index").agg(F.min("text").alias("text"))
    scenes = chunks.groupBy("book_key", "plot_index").agg(T.match_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "")).alias("text"))
    scored = A.score_scenes(anchors, scenes, ["book_key"], "conversation_id", ["utterance_index", "utterance_id"], "plot_index")
    return J.chosen(scored, ["conversation_id", "book_key"], "plot_index").select("conversation_id", "book_key", "plot_index", "score", "coverage", "anchors")


@query("""
    WITH c AS (SELECT message_id, chat_session_id, unnest(regexp_extract_all(tool_calls_json, '"id"\\s*:\\s*"([^"]+)"', 1)) AS call_id FROM (SELECT DISTINCT message_id, chat_session_id, tool_calls_json FROM chat_messages) WHERE tool_calls_json IS NOT NULL),
    t AS (SELECT chat_session_id, tool_call_id AS call_id, min(message_id) AS answer_id FROM chat_messages WHERE tool_call_id IS NOT NULL GROUP BY ALL)
    SELECT c.message_id, c.call_id, t.answer_id FROM c LEFT JOIN t ON c.chat_session_id = t.chat_session_id AND c.call_id = t.call_id""")
def call_answers(spark, sf_dir):
    """Tool calls and the message that answers each."""
    m = table(spark, sf_dir, "chat_messages")
    calls = m.select("message_id", "chat_session_id", "tool_calls_json").distinct().select("message_id", "chat_session_id", F.explode(F.regexp_extract_all("tool_calls_json", F.lit(r'"id"\s*:\s*"([^"]+)"'), F.lit(1))).alias("call_id"))
    answers = m.filter("tool_call_id is not null").groupBy("chat_session_id", F.col("tool_call_id").alias("call_id")).agg(F.min("message_id").alias("answer_id"))
    return calls.join(answers, ["chat_session_id", "call_id"], "left").select("message_id", "call_id", "answer_id")


@query(f"""
    WITH c AS (SELECT DISTINCT book_key, unnest(names) AS name FROM {_OBS}), u AS (SELECT DISTINCT book_key, speaker FROM utterances WHERE speaker IS NOT NULL)
    SELECT u.book_key, u.speaker, EXISTS (SELECT 1 FROM c WHERE c.book_key = u.book_key AND c.name = u.speaker) AS in_catalogue FROM u""")
def used_speakers(spark, sf_dir):
    """Speakers, and whether the catalogue has them."""
    named = observations(spark, sf_dir).select("book_key", F.explode("names").alias("speaker")).distinct().withColumn("k", F.lit(True))
    return table(spark, sf_dir, "utterances").filter("speaker is not null").select("book_key", "speaker").distinct().join(named, ["book_key", "speaker"], "left").select("book_key", "speaker", F.coalesce("k", F.lit(False)).alias("in_catalogue"))


@query("""
    WITH c AS (SELECT DISTINCT candidate_id, book_key, character_name, validations FROM candidates), p AS (SELECT candidate_id, book_key, CASE WHEN len(validations) > 0 AND character_name IS NOT NULL AND character_name <> 'Unknown' THEN 0 WHEN len(validations) > 0 THEN 1 WHEN character_name IS NOT NULL AND character_name <> 'Unknown' THEN 2 ELSE 3 END AS priority, md5('7:' || candidate_id) AS h FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY priority, h) AS place, greatest(1, floor(count(*) OVER (PARTITION BY book_key) * 0.3 + 0.5)) AS target FROM p)
    SELECT candidate_id, book_key, priority, place FROM r WHERE place <= target""")
def tiered_sample(spark, sf_dir):
    """Three tenths of each book's candidates, tier by tier, shuffled by a seeded hash."""
    rows = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", "character_name", "validations").distinct()
    named = F.col("character_name").isNotNull() & (F.col("character_name") != "Unknown")
    checks = F.coalesce(F.size("validations"), F.lit(0)) > 0
    tier = F.when(checks & named, 0).when(checks, 1).when(named, 2).otherwise(3)
    return R.tiered_sample(rows.withColumn("priority", tier), ["book_key"], "priority", "candidate_id", 0.3, 7).select("candidate_id", "book_key", "priority", F.col("place").cast("bigint").alias("place"))


@query("""
    WITH c AS (SELECT DISTINCT candidate_id, coalesce(book_key, '') AS book_key FROM candidates),
    k AS (SELECT candidate_id, book_key, md5('11:' || candidate_id) AS h, row_number() OVER (PARTITION BY book_key ORDER BY md5('11:' || candidate_id), candidate_id) AS place FROM c)
    SELECT candidate_id, printf('eval-%06d', row_number() OVER (ORDER BY h, candidate_id)) AS sample_id FROM k WHERE place <= 20""")
def balanced_subset(spark, sf_dir):
    """At most twenty candidates of each book, shuffled, with running ids."""
    rows = table(spark, sf_dir, "candidates").select("candidate_id", F.coalesce("book_key", F.lit("")).alias("book_key")).distinct()
    kept = R.balanced(rows, ["book_key"], "candidate_id", 20, 11)
    numbered = R.global_row_number(kept.select("_h", "candidate_id"), ["_h", "candidate_id"], "place")
    return numbered.select("candidate_id", F.format_string("eval-%06d", "place").alias("sample_id"))


@query("""
    WITH m AS (SELECT DISTINCT message_id, chat_session_id, created_at FROM chat_messages),
    r AS (SELECT *, row_number() OVER (PARTITION BY chat_session_id ORDER BY message_id DESC) AS back, count(*) OVER (PARTITION BY chat_session_id) AS n FROM m)
    SELECT chat_session_id, message_id, (least(n, 3) - back)::BIGINT AS place, n > 3 AS has_more, min(message_id) OVER (PARTITION BY chat_session_id) AS next_before FROM r WHERE back <= 3""")
def newest_page(spark, sf_dir):
    """The newest three messages of each session, oldest first, and where the page before ends."""
    m = table(spark, sf_dir, "chat_messages").select("message_id", "chat_session_id").distinct()
    return R.newest_page(m, ["chat_session_id"], "message_id", 3)


@query("""
    WITH u AS (SELECT book_key, plot_index, sum(length(text))::BIGINT AS tokens FROM (SELECT DISTINCT plot_chunk_id, book_key, plot_index, text FROM plot_chunks) GROUP BY ALL)
    SELECT book_key, plot_index, tokens FROM u WHERE tokens >= 512""")
def minimum_plots(spark, sf_dir):
    """Scenes of at least 512 code points."""
    p = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "book_key", "plot_index", "text").distinct()
    return p.groupBy("book_key", "plot_index").agg(F.sum(F.length("text")).alias("tokens")).filter("tokens >= 512")


@query("""
    WITH c AS (SELECT DISTINCT chunk_id, chunk_index, text, token_count FROM text_chunks)
    SELECT chunk_id, concat_ws(',', CASE WHEN NOT coalesce(chunk_index >= 0, false) THEN 'index' END, CASE WHEN NOT coalesce(length(text) > 0, false) THEN 'text' END, CASE WHEN NOT coalesce(token_count >= 0, false) THEN 'count' END, CASE WHEN NOT coalesce(token_count = length(text), false) THEN 'stale' END) AS broken FROM c""")
def chunk_contracts(spark, sf_dir):
    """Which rules each chunk breaks."""
    c = table(spark, sf_dir, "text_chunks").select("chunk_id", "chunk_index", "text", "token_count").distinct()
    out = J.checked(c, index=F.col("chunk_index") >= 0, text=F.length("text") > 0, count=F.col("token_count") >= 0, stale=F.col("token_count") == F.length("text"))
    return out.select("chunk_id", F.array_join("broken", ",").alias("broken"))


@query("""
    WITH o AS (SELECT DISTINCT output_id, provider, model, stage, content, finish_reason, total_tokens, input_tokens, output_tokens FROM llm_outputs)
    SELECT coalesce(stage, '') AS stage, count(*) AS outputs, count(*) FILTER (WHERE content IS NULL) AS failed, count(*) FILTER (WHERE content = '') AS empty, count(*) FILTER (WHERE lower(finish_reason) IN ('length', 'max_tokens', 'max_output_tokens')) AS at_length,
        count(*) FILTER (WHERE total_tokens <> input_tokens + output_tokens) AS wrong_totals, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM o GROUP BY 1""")
def quality_counters(spark, sf_dir):
    """Failures, empty results and doubtful counts of each stage."""
    o = table(spark, sf_dir, "llm_outputs").select("output_id", "provider", "model", "stage", "content", "finish_reason", "total_tokens", "input_tokens", "output_tokens").distinct()
    return o.groupBy(F.coalesce("stage", F.lit("")).alias("stage")).agg(F.count("*").alias("outputs"), F.count_if(F.col("content").isNull()).alias("failed"), F.count_if(F.col("content") == "").alias("empty"), F.count_if(F.lower("finish_reason").isin("length", "max_tokens", "max_output_tokens")).alias("at_length"), F.count_if(F.col("total_tokens") != F.col("input_tokens") + F.col("output_tokens")).alias("wrong_totals"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


@query(f"""
    WITH l AS (SELECT DISTINCT u.conversation_id, u.book_key, u.speaker FROM utterances u WHERE speaker <> 'Environment'),
    c AS (SELECT DISTINCT book_key, unnest(names) AS name FROM {_OBS})
    SELECT c.book_key, c.name, count(DISTINCT l.conversation_id) AS samples FROM c LEFT JOIN l ON l.book_key = c.book_key AND l.speaker = c.name WHERE c.name IS NOT NULL GROUP BY ALL""")
def sample_counts(spark, sf_dir):
    """How many samples each character of the catalogue gets, none included."""
    c = observations(spark, sf_dir).select("book_key", F.explode("names").alias("name")).filter("name is not null").distinct()
    said = table(spark, sf_dir, "utterances").filter(F.col("speaker") != T.NARRATOR).select("conversation_id", "book_key", F.col("speaker").alias("name")).distinct()
    return c.join(said, ["book_key", "name"], "left").groupBy("book_key", "name").agg(F.count_distinct("conversation_id").alias("samples"))


@query(f"""
    WITH l AS (SELECT conversation_id, utterance_index, utterance_id, content FROM {_LINES})
    SELECT conversation_id, count(*) AS lines, md5(coalesce(string_agg(content, '' ORDER BY utterance_index, utterance_id), '')) AS text_md5 FROM l GROUP BY 1""")
def conversation_texts(spark, sf_dir):
    """All that is said in a conversation, joined in order."""
    g = lines(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("lines"), S.joined_in_order(["utterance_index", "utterance_id"], F.col("content"), "").alias("t"))
    return g.select("conversation_id", "lines", F.md5("t").alias("text_md5"))


@query("""
    WITH e AS (SELECT DISTINCT candidate_id, messages, reference_response FROM candidates)
    SELECT candidate_id, len(messages)::INT AS messages, coalesce(messages[-1].content = reference_response, false) AS same_response, list_aggregate(list_transform(messages[:-2], lambda m: m.role), 'string_agg', '>') AS roles_before FROM e""")
def message_prefixes(spark, sf_dir):
    """The messages before each target, and whether the target is the reference response."""
    e = table(spark, sf_dir, "candidates").select("candidate_id", "messages", "reference_response").distinct()
    before = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    return e.select("candidate_id", F.size("messages").alias("messages"), F.coalesce(F.try_element_at("messages", F.lit(-1))["content"] == F.col("reference_response"), F.lit(False)).alias("same_response"), F.array_join(F.transform(before, lambda m: m["role"]), ">").alias("roles_before"))


@query("""
    WITH p AS (SELECT DISTINCT candidate_id, book_key, plot_index, character_name FROM candidates WHERE character_name IS NOT NULL)
    SELECT candidate_id, (('0x' || substr(md5(coalesce(plot_index::VARCHAR, '') || ':' || character_name), 1, 8))::BIGINT % 4)::INT AS template FROM p""")
def template_choices(spark, sf_dir):
    """One of four templates for each scene and character, evenly and always the same."""
    p = table(spark, sf_dir, "candidates").filter("character_name is not null").select("candidate_id", "book_key", "plot_index", "character_name").distinct()
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col("plot_index").cast("string"), F.lit("")), F.lit(":"), "character_name")), 1, 8)
    return p.select("candidate_id", (F.conv(digest, 16, 10).cast("bigint") % 4).cast("int").alias("template"))


@query("""
    WITH c AS (SELECT DISTINCT file, chunk_index FROM text_chunks WHERE chunk_index IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk_index) - 1 AS pos, count(*) OVER (PARTITION BY file) AS n FROM c)
    SELECT file, chunk_index FROM r WHERE pos < 3 OR pos >= n - 3 OR (pos >= (n - 4) // 2 AND pos < (n - 4) // 2 + 4)""")
def spine_sample(spark, sf_dir):
    """The first three, the middle four and the last three chunks of each file."""
    c = table(spark, sf_dir, "text_chunks").filter("chunk_index is not null").select("file", "chunk_index").distinct()
    return R.spine_sample(c, ["file"], "chunk_index").select("file", "chunk_index")


@query("""
    SELECT book_key, display_name, narrative_order, row_number() OVER (ORDER BY narrative_order, path) AS place FROM (SELECT DISTINCT book_key, path, display_name, narrative_order FROM text_resources)""")
def narrative_order(spark, sf_dir):
    """Resources in the order of the story."""
    r = table(spark, sf_dir, "text_resources").select("book_key", "path", "display_name", "narrative_order").distinct()
    return R.global_row_number(r, ["narrative_order", "path"], "place").drop("path")


@query("""
    WITH d AS (SELECT doc_id, doc_kind, n_chars, count(*) OVER () AS n, count(*) FILTER (doc_kind = 'notes') OVER () AS a, count(*) FILTER (doc_kind = 'summary') OVER () AS b FROM documents),
    x AS (SELECT *, 2 * (least(a, b) // 3) + 1 AS gone FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY md5('11:' || doc_id), doc_id) AS k FROM x),
    kept AS (SELECT * FROM r WHERE NOT (doc_kind = 'notes' AND k <= gone // 2) AND NOT (doc_kind = 'summary' AND k <= gone - gone // 2) OR doc_kind IS NULL)
    SELECT doc_id, doc_kind, row_number() OVER (ORDER BY doc_id) AS place FROM kept""")
def equal_deletions(spark, sf_dir):
    """All documents but some notes and as many summaries."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "doc_kind")
    n = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_kind") == "notes").alias("a"), F.count_if(F.col("doc_kind") == "summary").alias("b")).first()
    return R.equal_deletions(docs, "doc_kind", ["doc_id"], "doc_id", ["notes", "summary"], n["n"] - 2 * (min(n["a"], n["b"]) // 3) - 1, 11)


@query(f"""
    WITH c AS (SELECT DISTINCT file, chunk_id, chunk_index FROM {_CHUNKS}),
    r AS (SELECT path, min(narrative_order) AS o FROM text_resources WHERE narrative_order IS NOT NULL GROUP BY 1)
    SELECT c.file, c.chunk_id, row_number() OVER (ORDER BY r.o, c.file, c.chunk_index, c.chunk_id) - 1 AS global_index FROM c JOIN r ON c.file = r.path""")
def appended_chunks(spark, sf_dir):
    """The chunks of all resources under one running index."""
    rows = chunks(spark, sf_dir).select("file", "chunk_id", "chunk_index").distinct().withColumn("_order", F.struct("chunk_index", "chunk_id"))
    resources = table(spark, sf_dir, "text_resources").filter("narrative_order is not null").groupBy(F.col("path").alias("file")).agg(F.min("narrative_order").alias("narrative_order"))
    return D.appended_chunks(rows, resources, "file", "narrative_order", "_order").select("file", "chunk_id", "global_index")


@query("""
    WITH u AS (SELECT DISTINCT utterance_id, book_key, plot_index, utterance_index, 0 AS side FROM utterances WHERE speaker <> 'Environment'),
    v AS (SELECT DISTINCT utterance_id, book_key, plot_index, utterance_index, 1 AS side FROM utterances WHERE speaker = 'Environment'),
    b AS (SELECT * FROM u UNION ALL SELECT * FROM v)
    SELECT utterance_id, side, row_number() OVER (PARTITION BY book_key, plot_index ORDER BY utterance_index NULLS LAST, side, utterance_id) - 1 AS place FROM b""")
def ordered_merge(spark, sf_dir):
    """What is said and what is told in a scene, merged by position."""
    u = table(spark, sf_dir, "utterances").select("utterance_id", "book_key", "plot_index", "utterance_index", "speaker").distinct()
    said, told = (u.filter(x).drop("speaker") for x in (F.col("speaker") != T.NARRATOR, F.col("speaker") == T.NARRATOR))
    return D.ordered_merge(said, told, ["book_key", "plot_index"], "utterance_index", ["utterance_id"]).select("utterance_id", "side", "place")


@query("""
    WITH m AS (SELECT message_id, max(created_at) AS at, arg_max(coalesce(content, ''), (created_at, coalesce(content, ''))) AS content, arg_max(kind, (created_at, coalesce(content, ''))) AS kind FROM chat_messages WHERE message_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1)
    SELECT message_id, content FROM m WHERE message_id % 2 = 0 AND message_id % 3 <> 0
    UNION ALL SELECT message_id, content || '!' FROM m WHERE message_id % 3 = 0 AND kind <> 'event'""")
def applied_changes(spark, sf_dir):
    """Messages after a set of changes: every third is changed or added, events among those are deleted."""
    last = F.struct("created_at", F.coalesce("content", F.lit("")))
    m = table(spark, sf_dir, "chat_messages").filter("message_id is not null and created_at is not null").groupBy("message_id").agg(F.max_by(F.coalesce("content", F.lit("")), last).alias("content"), F.max_by("kind", last).alias("kind"), F.max("created_at").alias("at"))
    third = m.filter("message_id % 3 = 0")
    early = third.select("message_id", F.lit("early").alias("content"), F.lit(False).alias("gone"), F.lit(0).alias("turn"))
    late = third.select("message_id", F.concat("content", F.lit("!")).alias("content"), (F.col("kind") == "event").alias("gone"), F.lit(1).alias("turn"))
    return D.apply_changes(m.filter("message_id % 2 = 0").select("message_id", "content"), early.unionByName(late), ["message_id"], "gone", "turn")


@query("""
    WITH p AS (SELECT book_key, plot_index, chunk_index, min(text) AS t FROM plot_chunks WHERE chunk_index >= 0 GROUP BY ALL),
    c AS (SELECT DISTINCT p.* FROM p JOIN utterances u ON u.book_key = p.book_key AND u.plot_index = p.plot_index),
    n AS (SELECT *, row_number() OVER (PARTITION BY book_key, plot_index ORDER BY chunk_index) - 1 AS k FROM c),
    g AS (SELECT book_key, plot_index, count(*) AS chunks, string_agg(t, '' ORDER BY chunk_index) AS t, sum(length(t)) - arg_max(length(t), chunk_index) AS last_start FROM n WHERE k = chunk_index GROUP BY ALL)
    SELECT book_key, plot_index, chunks, md5(t) AS text_md5, last_start::BIGINT AS last_start FROM g""")
def scene_texts(spark, sf_dir):
    """The covered beginning of each scene, and where its last chunk begins."""
    p = table(spark, sf_dir, "plot_chunks").groupBy("book_key", "plot_index", "chunk_index").agg(F.min("text").alias("text"))
    said = table(spark, sf_dir, "utterances").select("book_key", "plot_index").distinct()
    out = D.scene_texts(p, p.join(said, ["book_key", "plot_index"], "left_semi"), ["book_key", "plot_index"], "chunk_index", "text")
    return out.select("book_key", "plot_index", "chunks", F.md5("text").alias("text_md5"), F.element_at("starts", -1).alias("last_start"))


@query("""
    WITH e AS (SELECT DISTINCT candidate_id, messages FROM candidates), m AS (SELECT candidate_id, unnest(range(len(messages))) AS i, unnest(messages) AS m FROM e),
    l AS (SELECT candidate_id, i, m.role AS role, unnest(range(len(CASE WHEN m.role = 'user' THEN string_split_regex(coalesce(m.content, ''), '\\r\\n|\\r|\\n') ELSE [coalesce(m.content, '')] END))) AS k,
        unnest(CASE WHEN m.role = 'user' THEN string_split_regex(coalesce(m.content, ''), '\\r\\n|\\r|\\n') ELSE [coalesce(m.content, '')] END) AS line FROM m WHERE m.role <> 'system')
    SELECT candidate_id, i::INT AS message_index, k::INT AS unit_index, role <> 'user' AS reply FROM l WHERE regexp_replace(line, '^[ \\t\\n\\r\\x{3000}\\x{a0}\\v\\f]+|[ \\t\\n\\r\\x{3000}\\x{a0}\\v\\f]+$', '', 'g') <> ''""")
def message_units(spark, sf_dir):
    """The units of all messages: replies whole, a user's line by line."""
    rows = table(spark, sf_dir, "candidates").select("candidate_id", "messages").distinct()
    return D.message_units(rows, ["candidate_id"]).select("candidate_id", "message_index", "unit_index", (F.col("kind") == "reply").alias("reply"))


@query("""
    WITH n AS (SELECT DISTINCT candidate_id, book_key, plot_index, messages FROM candidates), m AS (SELECT candidate_id, book_key, plot_index, unnest(range(len(messages))) AS i, unnest(messages) AS m FROM n)
    SELECT book_key, plot_index, count(*) AS changes, md5(string_agg(coalesce(m.role, ''), '|' ORDER BY candidate_id, i)) AS roles FROM m GROUP BY ALL""")
def transition_documents(spark, sf_dir):
    """The nested document of each scene, read back and counted."""
    m = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", "plot_index", "messages").distinct().select("candidate_id", "book_key", "plot_index", F.posexplode("messages").alias("i", "m")).select("candidate_id", "book_key", "plot_index", "i", F.coalesce("m.role", F.lit("")).alias("role"), F.array("m.content").alias("nodes"))
    out = D.transition_document(m, ["book_key", "plot_index"], ["candidate_id", "i"], "role", "nodes")
    back = F.from_json("document", "array<struct<source: string, nodes: array<string>>>")
    return out.select("book_key", "plot_index", F.size(back).cast("bigint").alias("changes"), F.md5(F.array_join(F.transform(back, lambda x: x["source"]), "|")).alias("roles"))
