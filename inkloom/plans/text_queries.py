"""Queries of scans, text functions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import chunking
from inkloom.plans.registry import query
from inkloom.session import table

#: Headings of the corpus's languages, beside the default ones.
CORPUS_CHAPTERS = [*T.CHAPTER_HEADINGS, "Chapter {num}", "Capítulo {num}", "Kapitel {num}"]
CORPUS_ENDS = T.SENTENCE_ENDS + "."
NUM = T.HEADING_NUMBER
WS = r"[ \t\n\r\x{3000}]"
CLOSE = r"[”’\"」』】））》〉〕〗〙〛\)\]]*"
SENT = rf"(?s:.*?(?:[。！？!?.]+{CLOSE}|\n[ \t\x{{3000}}]*\n){WS}*|.+)"
_CHUNK_SQL = """
    WITH RECURSIVE s AS (
        SELECT {key}, regexp_extract_all(t, '{sent}') AS l FROM (SELECT {key}, regexp_replace({text}, '\\r\\n?', chr(10), 'g') AS t FROM {source}) WHERE regexp_matches(t, '[^ \\t\\n\\r\\x{{3000}}]')),
    e AS (SELECT {key}, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM s),
    p AS (
        SELECT {key}, pos, x, length(x) AS held, 0 AS c{first} FROM e WHERE pos = 1
        UNION ALL
        SELECT e.{key}, e.pos, e.x, CASE WHEN {cut} THEN length(e.x) ELSE p.held + length(e.x) END, CASE WHEN {cut} THEN p.c + 1 ELSE p.c END{next} FROM p JOIN e ON e.{key} = p.{key} AND e.pos = p.pos + 1)
    SELECT {key}, c AS chunk_index, sum(length(x))::INT AS token_count, string_agg(x, '' ORDER BY pos) AS text FROM p GROUP BY {key}, c"""


@query(_CHUNK_SQL.format(key="doc_id", text="text", source="documents", sent=SENT.replace("'", "''"), cut="p.held >= 200", first="", next=""))
def sentence_chunks(spark, sf_dir):
    """Documents in chunks of whole sentences that reach or cross 200 code points."""
    return chunking.pack_sentences(table(spark, sf_dir, "documents"), ["doc_id"], "text", 200, CORPUS_ENDS)


@query(_CHUNK_SQL.format(key="plot_chunk_id", text="text", source="(SELECT DISTINCT plot_chunk_id, text FROM plot_chunks)", sent=SENT.replace("'", "''"), cut="p.held + length(e.x) > 500", first="", next=""))
def flush_chunks(spark, sf_dir):
    """Scenes in chunks of whole sentences that don't exceed 500 code points."""
    rows = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "text").distinct()
    return chunking.pack_sentences(rows, ["plot_chunk_id"], "text", 500, CORPUS_ENDS, crossing=False)


_HEAD = f"^[ \\t\\x{{3000}}]*(?:(?:第{NUM}章)|(?:第{NUM}话)|(?:第{NUM}節)|(?:第{NUM}节)|(?:序章)|(?:序曲)|(?:终章)|(?:終章)|(?:尾声)|(?:尾聲)|(?:后记)|(?:後記)|(?:Chapter {NUM})|(?:Capítulo {NUM})|(?:Kapitel {NUM}))[^\\r\\n]*$"


@query(f"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line_number, unnest(l) AS x FROM l)
    SELECT doc_id, line_number, trim(x, ' ' || chr(9) || chr(12288)) AS heading FROM e WHERE regexp_matches(x, '{_HEAD}')""")
def heading_lines(spark, sf_dir):
    """Every heading line of the corpus with its number."""
    return chunking.heading_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text", CORPUS_CHAPTERS)


@query(f"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM l),
    m AS (SELECT *, regexp_matches(x, '{_HEAD}') AS h FROM e),
    g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec, bool_or(h) OVER (PARTITION BY doc_id) AS any_h FROM m),
    b AS (SELECT doc_id, sec, max(CASE WHEN h THEN trim(x, ' ' || chr(9) || chr(12288)) END) AS heading, trim(coalesce(string_agg(CASE WHEN NOT h THEN x END, chr(10) ORDER BY pos), ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) AS body FROM g WHERE sec > 0 OR NOT any_h GROUP BY doc_id, sec)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section_index, coalesce(heading, '') AS heading, length(body) AS body_chars, md5(body) AS body_md5 FROM b WHERE body <> ''""")
def sections(spark, sf_dir):
    """Documents cut at chapter headings; front matter goes."""
    out = chunking.split_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", chapters=CORPUS_CHAPTERS)
    return out.select("doc_id", "section_index", "heading", F.length("body").cast("bigint").alias("body_chars"), F.md5("body").alias("body_md5"))


@query(r"""
    WITH c AS (SELECT DISTINCT candidate_id, list_filter(messages, lambda m: m.role = 'user') AS u FROM candidates),
    l AS (SELECT candidate_id, string_split(u[-1].content, chr(10)) AS l FROM c WHERE len(u) > 0),
    e AS (SELECT candidate_id, unnest(range(1, len(l) + 1))::INT AS line_number, trim(unnest(l), ' ' || chr(9) || chr(13) || chr(12288)) AS x FROM l),
    p AS (SELECT *, regexp_matches(x, '(?s)^\*\(.*[^ \t\n\r\x{3000}].*\)\*$') AS nar,
        trim(regexp_extract(x, '(?s)^([^:：\n]{1,40})[:：](.*)$', 1), ' ' || chr(9) || chr(12288)) AS n, trim(regexp_extract(x, '(?s)^([^:：\n]{1,40})[:：](.*)$', 2), ' ' || chr(9) || chr(12288)) AS w FROM e)
    SELECT candidate_id, line_number, CASE WHEN nar THEN 'narration' WHEN n <> '' AND w <> '' THEN 'speech' ELSE 'plain' END AS kind,
        CASE WHEN NOT nar AND n <> '' AND w <> '' THEN CASE WHEN regexp_matches(n, '^未知角色[0-9]*$') THEN '' ELSE n END ELSE 'Environment' END AS speaker,
        CASE WHEN NOT nar AND n <> '' AND w <> '' THEN w ELSE x END AS content
    FROM p""")
def prompt_lines(spark, sf_dir):
    """The lines of each last user message by kind, speaker and content."""
    rows = table(spark, sf_dir, "candidates").select("candidate_id", "messages").distinct()
    said = rows.select("candidate_id", F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"].alias("c")).filter("c is not null")
    lines = said.select("candidate_id", F.posexplode(F.split("c", "\n")).alias("at", "line"))
    return lines.select("candidate_id", (F.col("at") + 1).alias("line_number"), *[v.alias(k) for k, v in T.parse_line(F.col("line")).items()])


@query(r"""
    WITH n AS (SELECT DISTINCT speaker FROM utterances WHERE speaker IS NOT NULL),
    f AS (SELECT speaker, regexp_replace(regexp_replace(speaker, '[\x{00}-\x{1f}<>:"/\\|?*]+', '_', 'g'), '^[ .\-]+|[ .\-]+$', '', 'g') AS safe FROM n)
    SELECT speaker, safe AS file_name,
        coalesce(nullif(regexp_replace(regexp_replace(lower(trim(speaker, ' ' || chr(9) || chr(10) || chr(13) || chr(12288))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), nullif(regexp_replace(regexp_replace(trim(speaker, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)), '[\x{00}-\x{1f}<>:"/\\|?*]+', '-', 'g'), '^[ .\-]+|[ .\-]+$', '', 'g'), ''), 'dataset') AS slug,
        coalesce(nullif(substr(trim(regexp_replace(speaker, '[ \t\n\r\x{3000}]+', ' ', 'g')), 1, 60), ''), 'New chat') AS title
    FROM f""")
def name_forms(spark, sf_dir):
    """File name, slug and title of every speaker."""
    names = table(spark, sf_dir, "utterances").select("speaker").filter("speaker is not null").distinct()
    s = F.col("speaker")
    return names.select("speaker", T.safe_filename(s).alias("file_name"), T.slug(s).alias("slug"), T.normalize_title(s).alias("title"))


@query(r"""
    WITH f AS (SELECT DISTINCT file || '#' || chunk_index AS path FROM text_chunks),
    k AS (SELECT path, list_aggregate(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE p END), 'string_agg', '') AS natural_key FROM f)
    SELECT path, natural_key, row_number() OVER (ORDER BY natural_key, path) AS place FROM k""")
def natural_order(spark, sf_dir):
    """Chunk paths in natural order: 2 before 10."""
    from inkloom.operators.ranking import global_row_number

    paths = table(spark, sf_dir, "text_chunks").select(F.concat("file", F.lit("#"), F.col("chunk_index").cast("string")).alias("path")).filter("path is not null").distinct()
    return global_row_number(paths.withColumn("natural_key", T.natural_key(F.col("path"))), ["natural_key", "path"], "place")


@query(r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^<>]+>', ' ', 'g'), '[ \t\n\r\x{3000}]+', ' ', 'g')) AS plain
    FROM documents WHERE text IS NOT NULL""")
def plain_text(spark, sf_dir):
    """Documents without mark-up, blanks collapsed."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", T.html_to_text(F.col("text")).alias("plain"))


@query(r"""
    WITH o AS (SELECT DISTINCT output_id, content FROM llm_outputs WHERE content IS NOT NULL),
    i AS (SELECT output_id, coalesce(nullif(regexp_extract(content, '(?s)```[a-zA-Z]*[ \t]*\n(.*?)\n?```', 1), ''), content) AS x FROM o),
    r AS (SELECT output_id, regexp_replace(regexp_extract(x, '(?s)[{\[].*[}\]]', 0), ',([ \t\r\n]*[}\]])', '\1', 'g') AS j FROM i),
    v AS (SELECT output_id, CASE WHEN starts_with(j, '{') AND json_valid(j) THEN j::JSON END AS j FROM r)
    SELECT output_id, j IS NOT NULL AS parsed, j->>'state' AS state, coalesce(json_array_length(j->'utterances'), 0)::INT AS utterances, coalesce(json_array_length(j->'nodes'), 0)::INT AS nodes FROM v""")
def json_repair(spark, sf_dir):
    """Model outputs parsed after repair: state, and how many utterances and nodes."""
    rows = table(spark, sf_dir, "llm_outputs").select("output_id", "content").filter("content is not null").distinct()
    fixed = rows.withColumn("j", T.repair_json(F.col("content")))
    shape = "struct<state string, utterances array<string>, nodes array<string>, _corrupt_record string>"
    parsed = fixed.withColumn("v", F.when(F.col("j").startswith("{"), F.from_json("j", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    ok = F.col("v").isNotNull() & F.col("v._corrupt_record").isNull() & F.expr("json_object_keys(j) is not null")
    return parsed.select("output_id", F.coalesce(ok, F.lit(False)).alias("parsed"), F.when(ok, F.col("v.state")).alias("state"), F.when(ok, F.greatest(F.size("v.utterances"), F.lit(0))).otherwise(0).alias("utterances"), F.when(ok, F.greatest(F.size("v.nodes"), F.lit(0))).otherwise(0).alias("nodes"))


@query(r"""
    WITH v AS (SELECT DISTINCT candidate_id, unnest(validations) AS v FROM candidates)
    SELECT DISTINCT v.name AS name, CASE WHEN regexp_matches(v.name, '^[^.]+\.[^.]+$') THEN regexp_extract(v.name, '^([^.]+)\.([^.]+)$', 1) || '.' || CASE WHEN regexp_extract(v.name, '^([^.]+)\.([^.]+)$', 2) IN ('位置', '地点') THEN 'location' ELSE regexp_extract(v.name, '^([^.]+)\.([^.]+)$', 2) END END AS state_name
    FROM v""")
def state_names(spark, sf_dir):
    """Every state name of the checks in its usual form."""
    names = table(spark, sf_dir, "candidates").select(F.explode("validations").alias("v")).select("v.name").distinct()
    return names.select("name", T.state_name(F.col("name")).alias("state_name"))


@query(r"""
    SELECT book_key, count(*) AS lines, count(*) FILTER (WHERE coalesce(regexp_matches(content, '(?s)^\*\(.*[^ \t\n\r\x{3000}].*\)\*$'), false)) AS narration,
        count(*) FILTER (WHERE speaker = 'Environment') AS narrator, count(*) FILTER (WHERE speaker = 'Environment' AND NOT coalesce(regexp_matches(content, '(?s)^\*\(.*[^ \t\n\r\x{3000}].*\)\*$'), false)) AS unmarked
    FROM (SELECT DISTINCT utterance_id, book_key, speaker, content FROM utterances) GROUP BY book_key""")
def narration_counts(spark, sf_dir):
    """Narration by mark and by speaker, per book."""
    rows = table(spark, sf_dir, "utterances").select("utterance_id", "book_key", "speaker", "content").distinct()
    marked, narrator = T.is_narration(F.col("content")), F.coalesce(F.col("speaker") == T.NARRATOR, F.lit(False))
    return rows.groupBy("book_key").agg(F.count("*").alias("lines"), F.count_if(marked).alias("narration"), F.count_if(narrator).alias("narrator"), F.count_if(narrator & ~marked).alias("unmarked"))


@query(r"""
    WITH u AS (SELECT DISTINCT utterance_id, speaker, content FROM utterances WHERE content IS NOT NULL)
    SELECT utterance_id, length(lower(regexp_replace(content, '[ \t\n\r\x{3000}\p{P}]+', '', 'g'))) AS match_chars, md5(lower(regexp_replace(content, '[ \t\n\r\x{3000}\p{P}]+', '', 'g'))) AS match_md5,
        CASE WHEN trim(coalesce(speaker, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) = '' THEN content ELSE speaker || '：' || content END AS line, replace(replace(content, chr(13), ''), chr(10), '') AS one_line
    FROM u""")
def match_texts(spark, sf_dir):
    """Utterances in the form for comparing, as lines with their speaker, and without line ends."""
    rows = table(spark, sf_dir, "utterances").select("utterance_id", "speaker", "content").filter("content is not null").distinct()
    c = F.col("content")
    return rows.select("utterance_id", F.length(T.match_text(c)).cast("bigint").alias("match_chars"), F.md5(T.match_text(c)).alias("match_md5"), T.speaker_line(F.col("speaker"), c).alias("line"), T.without_newlines(c).alias("one_line"))


@query(r"""
    WITH c AS (SELECT DISTINCT chunk_id, text FROM text_chunks WHERE text IS NOT NULL), n(needle) AS (VALUES ('the'), ('的'), ('der'), ('que'), ('の'))
    SELECT needle, count(*) FILTER (WHERE strpos(text, needle) > 0) AS chunks, sum(CASE WHEN length(text) >= length(needle) THEN len(list_filter(range(length(text) - length(needle) + 1), lambda i: substr(text, i + 1, length(needle)) = needle)) ELSE 0 END)::BIGINT AS places,
        sum(strpos(text, needle) - 1)::BIGINT AS first_sum
    FROM c, n GROUP BY needle""")
def needle_places(spark, sf_dir):
    """How often some words occur in the chunks, overlapping ones counted, and where first."""
    rows = table(spark, sf_dir, "text_chunks").select("chunk_id", "text").filter("text is not null").distinct()
    each = rows.withColumn("needle", F.explode(F.array(*[F.lit(x) for x in ("the", "的", "der", "que", "の")])))
    return each.groupBy("needle").agg(F.count_if(F.contains("text", "needle")).alias("chunks"), F.sum(F.size(T.occurrences(F.col("text"), F.col("needle")))).alias("places"), F.sum(T.find_from(F.col("text"), F.col("needle"), F.lit(0))).alias("first_sum"))


@query(r"""
    SELECT path, coalesce(path <> '' AND NOT regexp_matches(path, '^(?:[/\\]|[A-Za-z]:)') AND NOT list_contains(string_split(replace(path, '\', '/'), '/'), '..'), false) AS ok, resource_type, lower(resource_type) = 'text' AS is_text
    FROM (SELECT DISTINCT path, resource_type FROM text_resources)""")
def resource_paths(spark, sf_dir):
    """Input paths, whether they stay in the workspace, and whether they are texts."""
    rows = table(spark, sf_dir, "text_resources").select("path", "resource_type").distinct()
    return rows.select("path", T.relative_path_ok(F.col("path")).alias("ok"), "resource_type", (F.lower("resource_type") == "text").alias("is_text"))


_UNSAFE = ", ".join(f"'{n}'" for n in T.UNSAFE_NAMES)


@query(f"""
    WITH c AS (SELECT DISTINCT observation_id, names FROM character_candidates WHERE names IS NOT NULL),
    e AS (SELECT observation_id, unnest(range(len(names))) AS pos, trim(unnest(names), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) AS n FROM c),
    f AS (SELECT observation_id, n, min(pos) AS pos FROM e WHERE n IS NOT NULL AND n <> '' AND lower(n) NOT IN ({_UNSAFE}) GROUP BY observation_id, n)
    SELECT c.observation_id, coalesce(string_agg(n, '|' ORDER BY pos), '') AS names, count(n) AS n_names FROM (SELECT DISTINCT observation_id FROM c) c LEFT JOIN f USING (observation_id) GROUP BY c.observation_id""")
def safe_names(spark, sf_dir):
    """Names of the observations without those that name nobody, each once in first-seen order."""
    rows = table(spark, sf_dir, "character_candidates").select("observation_id", "names").filter("names is not null").distinct()
    kept = T.safe_names(F.col("names"))
    return rows.select("observation_id", F.array_join(kept, "|").alias("names"), F.size(kept).cast("bigint").alias("n_names"))


@query("""
    WITH c AS (SELECT DISTINCT candidate_id, book_key, title, reference_response FROM candidates WHERE reference_response IS NOT NULL),
    g AS (SELECT sha256(reference_response) AS fingerprint, count(*) AS candidates, count(DISTINCT book_key) AS books, min(candidate_id) AS first_candidate FROM c GROUP BY 1)
    SELECT fingerprint, candidates, books, first_candidate, books > 1 AS ambiguous FROM g""")
def fingerprint_identity(spark, sf_dir):
    """Which book a response's fingerprint recovers, and where it is ambiguous."""
    rows = table(spark, sf_dir, "candidates").select("candidate_id", "book_key", "reference_response").filter("reference_response is not null").distinct()
    g = rows.groupBy(F.sha2("reference_response", 256).alias("fingerprint")).agg(F.count("*").alias("candidates"), F.count_distinct("book_key").alias("books"), F.min("candidate_id").alias("first_candidate"))
    return g.withColumn("ambiguous", F.col("books") > 1)


@query(r"""
    SELECT chunk_id, printf('chunk-%06d', chunk_index) AS chunk_name, printf('s%05d-c%04d', chunk_index // 4, chunk_index) AS block_name, try_cast(meta['chapter'] AS BIGINT) AS chapter_number
    FROM (SELECT DISTINCT chunk_id, chunk_index, meta FROM text_chunks WHERE chunk_index IS NOT NULL)""")
def chunk_names(spark, sf_dir):
    """Formatted ids of the chunks and their chapter number as written."""
    rows = table(spark, sf_dir, "text_chunks").filter("chunk_index is not null").select("chunk_id", "chunk_index", F.try_element_at("meta", F.lit("chapter")).alias("chapter")).distinct()
    return rows.select("chunk_id", F.format_string("chunk-%06d", "chunk_index").alias("chunk_name"), F.format_string("s%05d-c%04d", F.floor(F.col("chunk_index") / 4), "chunk_index").alias("block_name"), T.permissive_int(F.col("chapter")).alias("chapter_number"))
