"""Queries of work units, records, tasks, profiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import records as K
from inkloom.plans.registry import query
from inkloom.plans.relation_queries import _OBS, observations
from inkloom.plans.sequence_queries import _CHUNKS, _LINES, _PLOT, chunks, lines, plot_chunks
from inkloom.session import table


@query("""
    WITH u AS (SELECT DISTINCT book_key, chunk_index FROM text_chunks WHERE chunk_index IS NOT NULL), r AS (SELECT DISTINCT book_key, unnest(source_refs).chunk_index AS chunk_index FROM plot_chunks)
    SELECT u.book_key, u.chunk_index, (row_number() OVER (PARTITION BY u.book_key ORDER BY u.chunk_index))::INT AS place FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.book_key = u.book_key AND r.chunk_index = u.chunk_index)""")
def job_places(spark, sf_dir):
    """Chunks no scene refers to yet, in the order in which they are to be done."""
    units = table(spark, sf_dir, "text_chunks").filter("chunk_index is not null").select("book_key", "chunk_index").distinct()
    done = table(spark, sf_dir, "plot_chunks").select("book_key", F.explode("source_refs").alias("r")).select("book_key", "r.chunk_index", F.lit("{}").alias("result"))
    return K.job_places(units, done, ["book_key"], "chunk_index", "result")


@query("""
    WITH c AS (SELECT DISTINCT candidate_id, book_key, sft_line, sft_message_index, character_name FROM candidates),
    m AS (SELECT row_number() OVER (ORDER BY candidate_id) AS line, candidate_id, character_name AS expected FROM (SELECT DISTINCT candidate_id, character_name FROM c)),
    p AS (SELECT row_number() OVER (ORDER BY candidate_id) AS line, s AS given FROM (SELECT DISTINCT candidate_id, CASE WHEN character_name = 'Unknown' THEN NULL ELSE character_name END AS s FROM c))
    SELECT line, candidate_id, expected, given, CASE WHEN expected IS DISTINCT FROM given THEN 'other label' END AS problem FROM m FULL JOIN p USING (line)""")
def prediction_lines(spark, sf_dir):
    """Predictions against their mapping, line by line."""
    from inkloom.operators.ranking import global_row_number

    c = table(spark, sf_dir, "candidates").select("candidate_id", F.col("character_name").alias("expected")).distinct()
    mapping = global_row_number(c, ["candidate_id"], "line")
    predictions = mapping.select("line", F.when(F.col("expected") != "Unknown", F.col("expected")).alias("given"))
    return K.zip_lines(mapping, predictions, "line", "expected", "given").select("line", "candidate_id", "expected", "given", "problem")


@query(f"""
    WITH t AS (SELECT DISTINCT candidate_id, book_key, character_name AS name, list_transform(validations, lambda v: v.description) AS v FROM candidates),
    k AS (SELECT DISTINCT book_key, unnest(names) AS name FROM {_OBS}),
    n AS (SELECT *, count(*) OVER (PARTITION BY book_key, name) AS n FROM t)
    SELECT candidate_id, CASE WHEN k.name IS NULL THEN 'unknown name' WHEN n.n > 1 THEN 'name twice' WHEN coalesce(len(v), 0) = 0 THEN 'no values' WHEN len(list_filter(v, lambda x: coalesce(trim(x), '') = '')) > 0 THEN 'empty value' WHEN len(list_distinct(v)) < len(v) THEN 'value twice' END AS problem
    FROM n LEFT JOIN k ON n.book_key = k.book_key AND n.name = k.name""")
def task_problems(spark, sf_dir):
    """What is wrong with a candidate's checks as tasks of its character."""
    t = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", F.col("character_name").alias("name"), F.transform("validations", lambda v: v["description"]).alias("v")).distinct()
    known = observations(spark, sf_dir).select("book_key", F.explode("names").alias("name")).distinct()
    return K.task_problems(t, ["book_key"], "name", "v", known).select("candidate_id", "problem")


@query(f"""
    WITH g AS (SELECT book_key, observation_id, unnest(list_distinct(names)) AS name FROM {_OBS}),
    p AS (SELECT book_key, names[1] AS name, max(description) AS profile FROM {_OBS} WHERE len(names) > 0 AND description <> '' GROUP BY ALL)
    SELECT g.book_key, g.observation_id, CASE WHEN count(DISTINCT profile) = 1 THEN min(profile) END AS profile, count(DISTINCT profile) > 1 AS conflict FROM g JOIN p USING (book_key, name) GROUP BY g.book_key, g.observation_id""")
def profile_matches(spark, sf_dir):
    """The profile that any name of an observation finds."""
    obs = observations(spark, sf_dir)
    profiles = obs.filter((F.size("names") > 0) & (F.col("description") != "")).groupBy("book_key", F.col("names")[0].alias("name")).agg(F.max("description").alias("profile"))
    return K.profiles_by_alias(obs, profiles, ["book_key"], "observation_id", "names", "name", "profile")


@query(f"""
    WITH o AS (SELECT DISTINCT utterance_id, book_key, speaker AS written FROM utterances WHERE speaker IS NOT NULL),
    c AS (SELECT DISTINCT book_key, names[1] AS name, unnest(names) AS alias FROM {_OBS} WHERE len(names) > 0),
    f AS (SELECT DISTINCT book_key, name FROM c), a AS (SELECT book_key, alias, min(name) AS name FROM c GROUP BY ALL HAVING count(DISTINCT name) = 1)
    SELECT o.utterance_id, o.written, coalesce(f.name, a.name) AS name FROM o LEFT JOIN f ON f.book_key = o.book_key AND f.name = o.written LEFT JOIN a ON a.book_key = o.book_key AND a.alias = o.written""")
def assigned_names(spark, sf_dir):
    """Speakers by formal name, or by an alias that is unique."""
    o = table(spark, sf_dir, "utterances").filter("speaker is not null").select("utterance_id", "book_key", F.col("speaker").alias("written")).distinct()
    c = observations(spark, sf_dir).filter(F.size("names") > 0).select("book_key", F.col("names")[0].alias("name"), "names")
    return K.assigned_names(o, c, ["book_key"], "written", "name", "names").select("utterance_id", "written", "name")


@query(f"""
    WITH f AS (SELECT book_key, names[1] AS name, description, min(observation_id) AS first FROM {_OBS} WHERE len(names) > 0 AND coalesce(trim(description), '') <> '' GROUP BY ALL)
    SELECT book_key, name, string_agg(description, chr(10) ORDER BY first) AS description FROM f GROUP BY ALL""")
def descriptions_by_name(spark, sf_dir):
    """All that is said of a name, each description once."""
    obs = observations(spark, sf_dir).filter(F.size("names") > 0).withColumn("name", F.col("names")[0])
    return K.descriptions_by_name(obs, ["book_key"], "name", "observation_id", "description")


@query("""
    WITH a AS (SELECT output_id, min(model) AS model, min(stage) AS stage, min(finish_reason) AS finish_reason FROM llm_outputs GROUP BY 1),
    b AS (SELECT output_id, model, lower(stage) AS stage, lower(finish_reason) AS finish_reason FROM a)
    SELECT a.output_id, concat_ws(',', CASE WHEN a.model IS DISTINCT FROM b.model THEN 'model' END, CASE WHEN a.stage IS DISTINCT FROM b.stage THEN 'stage' END, CASE WHEN a.finish_reason IS DISTINCT FROM b.finish_reason THEN 'finish_reason' END) AS changed FROM a JOIN b USING (output_id)""")
def changed_fields(spark, sf_dir):
    """Fields that bringing records to one case changes."""
    a = table(spark, sf_dir, "llm_outputs").groupBy("output_id").agg(F.min("model").alias("model"), F.min("stage").alias("stage"), F.min("finish_reason").alias("finish_reason"))
    b = a.withColumns({"stage": F.lower("stage"), "finish_reason": F.lower("finish_reason")})
    return K.changed_fields(a, b, "output_id", ["model", "stage", "finish_reason"]).withColumn("changed", F.array_join("changed", ","))


@query("""
    WITH p AS (SELECT DISTINCT plot_chunk_id, book_key, plot_index, chunk_index, source_refs FROM plot_chunks),
    e AS (SELECT book_key, plot_index, chunk_index, plot_chunk_id, unnest(range(len(source_refs))) AS pos, unnest(source_refs) AS r FROM p WHERE source_refs IS NOT NULL),
    f AS (SELECT book_key, plot_index, r.chunk_index AS c, r.span_start AS s, r.span_end AS t, min((chunk_index, plot_chunk_id, pos)) AS first FROM e GROUP BY ALL)
    SELECT p.book_key, p.plot_index, coalesce(string_agg(c || ':' || s || '-' || t, ' ' ORDER BY first), '') AS refs FROM (SELECT DISTINCT book_key, plot_index FROM p) p LEFT JOIN f USING (book_key, plot_index) GROUP BY ALL""")
def scene_refs(spark, sf_dir):
    """What a scene refers to, each span once."""
    p = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "book_key", "plot_index", "chunk_index", "source_refs").distinct()
    out = K.unique_refs(p, ["book_key", "plot_index"], ["chunk_index", "plot_chunk_id"], "source_refs")
    text = F.transform("source_refs", lambda r: F.concat(r["chunk_index"].cast("string"), F.lit(":"), r["span_start"].cast("string"), F.lit("-"), r["span_end"].cast("string")))
    return out.select("book_key", "plot_index", F.array_join(text, " ").alias("refs"))


@query("""
    SELECT DISTINCT book_key, plot_index, 'candidate' AS kind, 'old' AS side FROM candidates WHERE book_key IS NOT NULL
    UNION ALL SELECT DISTINCT book_key, plot_index, 'scene', 'new' FROM plot_chunks p WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.book_key = p.book_key AND c.plot_index = p.plot_index)""")
def keyed_union(spark, sf_dir):
    """Scenes of the candidates, and the scenes without one; both sides may share no key."""
    scenes = table(spark, sf_dir, "candidates").filter("book_key is not null").select("book_key", "plot_index", F.lit("candidate").alias("kind")).distinct()
    others = table(spark, sf_dir, "plot_chunks").select("book_key", "plot_index", F.lit("scene").alias("kind")).distinct().join(scenes.select("book_key", "plot_index"), ["book_key", "plot_index"], "left_anti")
    return K.keyed_union(scenes, others, ["book_key", "plot_index"])


@query("""
    SELECT DISTINCT p.book_key, p.plot_index FROM plot_chunks p JOIN candidates c ON p.book_key = c.book_key AND p.plot_index = c.plot_index""")
def union_overlap(spark, sf_dir):
    """The keys that would make the union of candidates' scenes and all scenes fail."""
    return K.overlap(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "plot_chunks"), ["book_key", "plot_index"])


@query(f"""
    WITH RECURSIVE s AS (SELECT book_key, chunk_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY book_key ORDER BY chunk_id) AS pos FROM (SELECT DISTINCT book_key, chunk_id, text FROM {_CHUNKS})),
    p AS (SELECT book_key, chunk_id, pos, n AS held, 0 AS pack FROM s WHERE pos = 1
        UNION ALL SELECT s.book_key, s.chunk_id, s.pos, CASE WHEN p.held > 0 AND p.held + s.n > 4000 THEN s.n ELSE p.held + s.n END, CASE WHEN p.held > 0 AND p.held + s.n > 4000 THEN p.pack + 1 ELSE p.pack END FROM p JOIN s ON s.book_key = p.book_key AND s.pos = p.pos + 1)
    SELECT book_key, chunk_id, pack FROM p""")
def budget_groups(spark, sf_dir):
    """Successive chunks of a book that fit 4,000 code points together."""
    c = chunks(spark, sf_dir).select("book_key", "chunk_id", "text").distinct()
    return K.budget_groups(c, ["book_key"], "chunk_id", F.length("text"), 4000)


@query(f"""
    WITH b AS (SELECT DISTINCT utterance_id, conversation_id, book_key, plot_index, source_refs[1].chunk_index AS chunk_index, utterance_index FROM utterances),
    k AS (SELECT *, row_number() OVER (PARTITION BY book_key, plot_index ORDER BY chunk_index NULLS FIRST, utterance_id) - 1 AS place FROM b),
    w AS (SELECT book_key, plot_index, list_sort(list(DISTINCT chunk_index)) AS want FROM {_PLOT} GROUP BY ALL),
    h AS (SELECT book_key, plot_index, list_sort(list(DISTINCT chunk_index)) AS have FROM b WHERE chunk_index IS NOT NULL GROUP BY ALL)
    SELECT k.utterance_id, k.place::INT AS place, coalesce(have = want, false) AS complete FROM k LEFT JOIN h USING (book_key, plot_index) LEFT JOIN w USING (book_key, plot_index)""")
def assembled_lines(spark, sf_dir):
    """Lines of a scene by source chunk, and whether all chunks have lines."""
    b = table(spark, sf_dir, "utterances").select("utterance_id", "conversation_id", "book_key", "plot_index", F.try_element_at("source_refs", F.lit(1))["chunk_index"].alias("chunk_index"), "utterance_index").distinct()
    return K.assemble(b, plot_chunks(spark, sf_dir), ["book_key", "plot_index"], "chunk_index", "utterance_id").select("utterance_id", "place", "complete")


@query("""
    WITH c AS (SELECT DISTINCT candidate_id, book_key, plot_index, character_name, validations, reference_response FROM candidates),
    u AS (SELECT DISTINCT book_key, content FROM utterances)
    SELECT c.book_key, count(*) AS candidates, count(*) FILTER (WHERE len(validations) > 0) AS preferred, count(*) FILTER (WHERE character_name IS NULL OR character_name = 'Unknown') AS nameless,
        count(*) FILTER (WHERE EXISTS (SELECT 1 FROM u WHERE u.book_key = c.book_key AND u.content = c.reference_response)) AS matched FROM c GROUP BY c.book_key""")
def match_report(spark, sf_dir):
    """Candidates of each book: with checks, without a name, with a response that is a known line."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", "plot_index", "character_name", "validations", "reference_response").distinct()
    u = table(spark, sf_dir, "utterances").filter("content is not null").select("book_key", F.col("content").alias("reference_response")).distinct().withColumn("k", F.lit(1))
    both = c.join(u, ["book_key", "reference_response"], "left")
    return both.groupBy("book_key").agg(F.count("*").alias("candidates"), F.count_if(F.size("validations") > 0).alias("preferred"), F.count_if(F.col("character_name").isNull() | (F.col("character_name") == "Unknown")).alias("nameless"), F.count("k").alias("matched"))


@query("""
    WITH m AS (SELECT DISTINCT message_id, chat_session_id, kind, sender_role, content, created_at FROM chat_messages)
    SELECT chat_session_id, epoch_us(max(created_at)) AS updated_us, count(*) FILTER (WHERE kind = 'message' AND sender_role <> 'tool' AND trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) <> '') AS shown, count(*) FILTER (WHERE kind = 'event') AS events,
        row_number() OVER (ORDER BY max(created_at) DESC, chat_session_id DESC) AS place FROM m GROUP BY chat_session_id""")
def recent_chats(spark, sf_dir):
    """Chats, the latest first, with how many of their messages are shown."""
    from inkloom.operators.ranking import global_row_number

    m = table(spark, sf_dir, "chat_messages").select("message_id", "chat_session_id", "kind", "sender_role", "content", "created_at").distinct()
    shown = (F.col("kind") == "message") & (F.col("sender_role") != "tool") & (T.strip(F.coalesce("content", F.lit(""))) != "")
    g = m.groupBy("chat_session_id").agg(F.max("created_at").alias("updated_at"), F.count_if(shown).alias("shown"), F.count_if(F.col("kind") == "event").alias("events"))
    keyed = g.withColumn("updated_us", F.unix_micros("updated_at")).drop("updated_at").withColumns({"_t": -F.col("updated_us"), "_i": -F.col("chat_session_id")})
    return global_row_number(keyed, ["_t", "_i"], "place").drop("_t", "_i")


@query(f"""
    WITH c AS (SELECT book_key, section, min(chunk_index) AS first, max(chunk_index) AS last FROM {_CHUNKS} GROUP BY ALL),
    p AS (SELECT book_key, plot_index, min(r.chunk_index) AS first, max(r.chunk_index) AS last FROM (SELECT book_key, plot_index, unnest(source_refs) AS r FROM plot_chunks) GROUP BY ALL)
    SELECT p.book_key, p.plot_index, count(*) AS chapters, string_agg(c.section, ' ' ORDER BY c.section) AS sections FROM p JOIN c ON c.book_key = p.book_key AND c.first <= p.last AND p.first <= c.last GROUP BY ALL""")
def scene_chapters(spark, sf_dir):
    """The chapters that a scene touches; one that crosses a border is in both."""
    c = chunks(spark, sf_dir).groupBy("book_key", "section").agg(F.min("chunk_index").alias("c1"), F.max("chunk_index").alias("c2"))
    refs = table(spark, sf_dir, "plot_chunks").select("book_key", "plot_index", F.explode("source_refs").alias("r"))
    p = refs.groupBy("book_key", "plot_index").agg(F.min("r.chunk_index").alias("p1"), F.max("r.chunk_index").alias("p2"))
    both = p.join(c, "book_key").filter((F.col("c1") <= F.col("p2")) & (F.col("p1") <= F.col("c2")))
    return both.groupBy("book_key", "plot_index").agg(F.count("*").alias("chapters"), F.array_join(F.array_sort(F.collect_list("section")), " ").alias("sections"))


@query(f"""
    WITH l AS (SELECT DISTINCT book_key, speaker FROM utterances WHERE speaker IS NOT NULL AND speaker <> 'Environment'),
    x AS (SELECT book_key, names[1] AS name FROM {_OBS} WHERE len(names) > 0 AND description IS NULL OR description = '')
    SELECT l.book_key, l.speaker FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.book_key = l.book_key AND x.name = l.speaker)""")
def kept_targets(spark, sf_dir):
    """Speakers that may be targets: those that aren't excluded, here for want of a description."""
    said = table(spark, sf_dir, "utterances").filter(F.col("speaker").isNotNull() & (F.col("speaker") != T.NARRATOR)).select("book_key", "speaker").distinct()
    out = observations(spark, sf_dir).filter(((F.size("names") > 0) & F.col("description").isNull()) | (F.col("description") == "")).select("book_key", F.try_element_at("names", F.lit(1)).alias("speaker")).distinct()
    return said.join(out, ["book_key", "speaker"], "left_anti")


@query(f"""
    WITH l AS (SELECT * FROM {_LINES}), s AS (SELECT DISTINCT conversation_id, speaker FROM l WHERE speaker IS NOT NULL)
    SELECT a.conversation_id AS a, b.conversation_id AS b, count(*) AS shared FROM s a JOIN s b ON a.speaker = b.speaker AND a.conversation_id < b.conversation_id
    JOIN (SELECT DISTINCT conversation_id, book_key, plot_index FROM utterances) x ON x.conversation_id = a.conversation_id JOIN (SELECT DISTINCT conversation_id, book_key, plot_index FROM utterances) y ON y.conversation_id = b.conversation_id AND y.book_key = x.book_key AND y.plot_index = x.plot_index GROUP BY ALL""")
def shared_speakers(spark, sf_dir):
    """Conversations of one scene and how many speakers they have in common."""
    where = table(spark, sf_dir, "utterances").select("conversation_id", "book_key", "plot_index").distinct()
    s = lines(spark, sf_dir).filter("speaker is not null").select("conversation_id", "speaker").distinct().join(where, "conversation_id")
    x, y = s.alias("x"), s.alias("y")
    on = (F.col("x.book_key") == F.col("y.book_key")) & (F.col("x.plot_index") == F.col("y.plot_index")) & (F.col("x.speaker") == F.col("y.speaker")) & (F.col("x.conversation_id") < F.col("y.conversation_id"))
    return x.join(y, on).groupBy(F.col("x.conversation_id").alias("a"), F.col("y.conversation_id").alias("b")).agg(F.count("*").alias("shared"))


@query(r"""
    WITH o AS (SELECT DISTINCT output_id, coalesce(nullif(regexp_extract(content, '(?s)```[a-zA-Z]*[ \t]*\n(.*?)\n?```', 1), ''), content) AS content FROM llm_outputs WHERE content IS NOT NULL),
    r AS (SELECT output_id, regexp_replace(regexp_extract(content, '(?s)[{\[].*[}\]]', 0), ',([ \t\r\n]*[}\]])', '\1', 'g') AS j FROM o)
    SELECT output_id, list_aggregate(list_sort(json_keys(j)), 'string_agg', ',') AS keys, list_sort(json_keys(j)) = ['utterances'] AS exact FROM r WHERE json_valid(j) AND j LIKE '{%'""")
def exact_fields(spark, sf_dir):
    """The fields of outputs that are JSON objects after repair, and whether they are just the wanted ones."""
    o = table(spark, sf_dir, "llm_outputs").filter(F.col("content").isNotNull()).select("output_id", "content").distinct()
    fixed = o.withColumn("j", T.repair_json(F.col("content")))
    kept = fixed.filter(F.col("j").startswith("{") & F.try_parse_json("j").isNotNull()).withColumn("k", F.array_sort(F.json_object_keys("j")))
    return kept.select("output_id", F.array_join("k", ",").alias("keys"), (F.col("k") == F.array(F.lit("utterances"))).alias("exact"))


@query(f"""
    SELECT chunk_id, coalesce(list_aggregate(list_filter(list_transform(CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\x{{3000}}]') THEN regexp_extract_all(text, '(?s:.*?(?:[。！？!?;；.]+[”’"」』】））》〉〕〗〙〛\\)\\]]*|\\n[ \\t\\x{{3000}}]*\\n)[ \\t\\n\\r\\x{{3000}}]*|.+)') ELSE [] END, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(12288))), lambda s: s <> ''), 'string_agg', chr(10)), '') AS sentences
    FROM (SELECT DISTINCT chunk_id, text FROM text_chunks WHERE text IS NOT NULL)""")
def trimmed_sentences(spark, sf_dir):
    """Sentences of the chunks, semicolons included as ends, one a line."""
    c = table(spark, sf_dir, "text_chunks").filter("text is not null").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.array_join(T.trimmed_sentences(F.col("text"), T.SENTENCE_ENDS + ";；."), "\n").alias("sentences"))


@query("""
    WITH b AS (SELECT DISTINCT book_key FROM text_resources),
    c AS (SELECT book_key, count(DISTINCT chunk_id) AS chunks FROM text_chunks GROUP BY 1), p AS (SELECT book_key, count(DISTINCT plot_index) AS plots FROM plot_chunks GROUP BY 1), u AS (SELECT book_key, count(DISTINCT conversation_id) AS conversations FROM utterances GROUP BY 1)
    SELECT CASE WHEN conversations > 0 THEN 'dialogue' WHEN plots > 0 THEN 'scenes' WHEN chunks > 0 THEN 'chunks' ELSE 'input' END AS status, count(*) AS books, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(sum(plots), 0)::BIGINT AS plots, coalesce(sum(conversations), 0)::BIGINT AS conversations
    FROM b LEFT JOIN c USING (book_key) LEFT JOIN p USING (book_key) LEFT JOIN u USING (book_key) GROUP BY 1""")
def project_summary(spark, sf_dir):
    """How far the books have come, and how much there is of each stage."""
    b = table(spark, sf_dir, "text_resources").select("book_key").distinct()
    for source, key, name in (("text_chunks", "chunk_id", "chunks"), ("plot_chunks", "plot_index", "plots"), ("utterances", "conversation_id", "conversations")):
        b = b.join(table(spark, sf_dir, source).groupBy("book_key").agg(F.count_distinct(key).alias(name)), "book_key", "left")
    status = F.when(F.col("conversations") > 0, "dialogue").when(F.col("plots") > 0, "scenes").when(F.col("chunks") > 0, "chunks").otherwise("input")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return b.groupBy(status.alias("status")).agg(F.count("*").alias("books"), total("chunks"), total("plots"), total("conversations"))


@query(f"""
    SELECT plot_chunk_id, arg_max(s, (length(s), s)) AS longest, count(*) AS sentences FROM (SELECT plot_chunk_id, unnest(regexp_extract_all(text, '[^。！？!?.]+')) AS s FROM {_PLOT}) GROUP BY 1""")
def longest_sentences(spark, sf_dir):
    """The longest sentence of each scene chunk."""
    s = plot_chunks(spark, sf_dir).select("plot_chunk_id", F.explode(F.regexp_extract_all("text", F.lit("[^。！？!?.]+"), F.lit(0))).alias("s"))
    return s.groupBy("plot_chunk_id").agg(F.max_by("s", F.struct(F.length("s"), "s")).alias("longest"), F.count("*").alias("sentences"))


