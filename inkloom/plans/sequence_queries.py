"""Queries of ordered rows: conversations, chunks, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import sequence as S
from inkloom.operators import state
from inkloom.plans.registry import query
from inkloom.plans.text_queries import CORPUS_ENDS, SENT
from inkloom.session import table

_LINES = "(SELECT conversation_id, utterance_index, speaker, content, min(utterance_id) AS utterance_id FROM utterances GROUP BY ALL)"
_SENT = SENT.replace("'", "''")


def lines(spark, sf_dir):
    """Utterances once each: a repeated row, or the same line under another id, counts once."""
    return table(spark, sf_dir, "utterances").groupBy("conversation_id", "utterance_index", "speaker", "content").agg(F.min("utterance_id").alias("utterance_id"))


def chunks(spark, sf_dir):
    """Text chunks once each, with their section as text."""
    section = F.concat_ws("|", F.coalesce(F.try_element_at("meta", F.lit("volume")), F.lit("")), F.coalesce(F.try_element_at("meta", F.lit("chapter")), F.lit("")))
    return table(spark, sf_dir, "text_chunks").select("chunk_id", "file", "book_key", "chunk_index", "text", "token_count", section.alias("section")).distinct()


_CHUNKS = "(SELECT DISTINCT chunk_id, file, book_key, chunk_index, text, token_count, coalesce(meta['volume'], '') || '|' || coalesce(meta['chapter'], '') AS section FROM text_chunks)"


@query(f"""
    WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(speaker) OVER w IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM {_LINES} WINDOW w AS (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id) AS run FROM m)
    SELECT conversation_id, run::BIGINT AS run, speaker, coalesce(string_agg(content, chr(10) ORDER BY utterance_index, utterance_id), '') AS content, count(*) AS lines FROM r GROUP BY conversation_id, run, speaker""")
def merged_speakers(spark, sf_dir):
    """Successive lines of one speaker as one."""
    return S.merge_speakers(lines(spark, sf_dir), ["conversation_id"], ["utterance_index", "utterance_id"])


@query(f"""
    WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(speaker) OVER w IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM {_LINES} WINDOW w AS (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id) AS run FROM m),
    g AS (SELECT conversation_id, run, speaker, coalesce(string_agg(content, chr(10) ORDER BY utterance_index, utterance_id), '') AS content FROM r GROUP BY conversation_id, run, speaker),
    t AS (SELECT DISTINCT conversation_id, speaker AS target FROM g WHERE speaker <> 'Environment' AND trim(speaker, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) <> ''),
    x AS (SELECT g.*, target, CASE WHEN speaker = target THEN 'assistant' ELSE 'user' END AS role, CASE WHEN trim(coalesce(speaker, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) = '' THEN content ELSE speaker || '：' || content END AS said FROM g JOIN t USING (conversation_id)),
    c2 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(role) OVER w = role THEN 0 ELSE 1 END AS c FROM x WINDOW w AS (PARTITION BY conversation_id, target ORDER BY run)),
    r2 AS (SELECT *, sum(c) OVER (PARTITION BY conversation_id, target ORDER BY run) AS turn FROM c2),
    y AS (SELECT conversation_id, target, turn::BIGINT AS turn, role, string_agg(said, chr(10) ORDER BY run) AS content FROM r2 GROUP BY conversation_id, target, turn, role),
    z AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conversation_id, target) AS last_turn FROM y)
    SELECT conversation_id, target, turn, role, content, CASE WHEN role = 'assistant' THEN true END AS loss FROM z WHERE turn <= last_turn""")
def role_samples(spark, sf_dir):
    """Chat samples of every speaker of every conversation."""
    return S.role_samples(lines(spark, sf_dir), ["conversation_id"], ["utterance_index", "utterance_id"])


@query(f"""
    WITH s AS (SELECT chunk_id, book_key, chunk_index, section, CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\x{{3000}}]') THEN regexp_extract_all(text, '{_SENT}') ELSE [] END AS l FROM {_CHUNKS}),
    n AS (SELECT *, lag(section) OVER w AS ps, lag(l) OVER w AS p, lead(section) OVER w AS ns, lead(l) OVER w AS n FROM s WINDOW w AS (PARTITION BY book_key ORDER BY chunk_index, chunk_id))
    SELECT chunk_id, CASE WHEN p IS NOT NULL AND ps = section THEN coalesce(list_aggregate(p[greatest(len(p) - 1, 1):], 'string_agg', ''), '') ELSE '' END AS previous_context,
        CASE WHEN n IS NOT NULL AND ns = section THEN coalesce(list_aggregate(n[:2], 'string_agg', ''), '') ELSE '' END AS next_context FROM n""")
def adjacent_context(spark, sf_dir):
    """Two sentences before and after each chunk, inside its section."""
    c = chunks(spark, sf_dir)
    return S.adjacent_context(c, ["book_key"], ["chunk_index", "chunk_id"], F.col("section"), T.split_sentences(F.col("text"), CORPUS_ENDS), 2).select("chunk_id", "previous_context", "next_context")


@query(f"""
    WITH e AS (SELECT *, lead(section) OVER w IS NULL OR lead(section) OVER w <> section AS section_end FROM {_CHUNKS} WINDOW w AS (PARTITION BY book_key ORDER BY chunk_index, chunk_id)),
    s AS (SELECT *, CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\x{{3000}}]') THEN regexp_extract_all(text, '{_SENT}') ELSE [] END AS l FROM e)
    SELECT chunk_id, section_end, CASE WHEN section_end THEN l[-1] END AS closing_sentence FROM s""")
def section_ends(spark, sf_dir):
    """Chunks that end a section, with the sentence that closes an open scene there."""
    marked = S.section_ends(chunks(spark, sf_dir), ["book_key"], ["chunk_index", "chunk_id"], F.col("section"))
    return marked.select("chunk_id", "section_end", F.when(F.col("section_end"), F.try_element_at(T.split_sentences(F.col("text"), CORPUS_ENDS), F.lit(-1))).alias("closing_sentence"))


_PLOT = "(SELECT DISTINCT plot_chunk_id, book_key, plot_index, chunk_index, text FROM plot_chunks)"


def plot_chunks(spark, sf_dir):
    """Scene chunks once each."""
    return table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", "book_key", "plot_index", "chunk_index", "text").distinct()


@query(f"""
    WITH b AS (SELECT *, ((row_number() OVER (PARTITION BY book_key, plot_index ORDER BY chunk_index, plot_chunk_id) - 1) // 4)::INT AS block FROM {_PLOT})
    SELECT book_key, plot_index, block, min(chunk_index) AS first, max(chunk_index) AS last, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM b GROUP BY book_key, plot_index, block""")
def fixed_blocks(spark, sf_dir):
    """Blocks of four scene chunks for one dialogue input."""
    placed = S.fixed_blocks(plot_chunks(spark, sf_dir), ["book_key", "plot_index"], "chunk_index", 4, "text")
    return placed.select("book_key", "plot_index", "block", "first", "last", "n", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))


@query("""
    WITH k AS (SELECT DISTINCT conversation_id, utterance_index, utterance_id, source_refs[1].chunk_index AS position FROM utterances)
    SELECT utterance_id, position, coalesce(position, first_value(position IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(position IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM k""")
def filled_positions(spark, sf_dir):
    """Source chunks of lines, the unknown ones taken from their neighbours."""
    known = table(spark, sf_dir, "utterances").select("conversation_id", "utterance_index", "utterance_id", F.try_element_at("source_refs", F.lit(1))["chunk_index"].alias("position")).distinct()
    return S.fill_positions(known, ["conversation_id"], ["utterance_index", "utterance_id"], "position").select("utterance_id", "position", "filled")


@query("""
    WITH d AS (SELECT DISTINCT book_key, plot_index, chunk_index FROM plot_chunks WHERE chunk_index IS NOT NULL),
    r AS (SELECT *, chunk_index = row_number() OVER (PARTITION BY book_key, plot_index ORDER BY chunk_index) - 1 AS ok FROM d)
    SELECT book_key, plot_index, count(*) AS n, count(*) FILTER (WHERE ok) AS prefix, bool_and(ok) AS complete FROM r GROUP BY book_key, plot_index""")
def contiguous_prefix(spark, sf_dir):
    """How far the chunks of each scene run without a gap."""
    return S.contiguous_prefix(table(spark, sf_dir, "plot_chunks"), ["book_key", "plot_index"], "chunk_index")


@query("""
    WITH s AS (SELECT DISTINCT plot_chunk_id, unnest(source_refs) AS r FROM plot_chunks),
    f AS (SELECT plot_chunk_id, r.path AS path, r.chunk_index AS chunk_index, r.span_start AS span_start, r.span_end - 1 AS last FROM s),
    o AS (SELECT *, max(last) OVER (PARTITION BY path, chunk_index ORDER BY span_start, last, plot_chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f)
    SELECT path, chunk_index, count(*) AS overlaps, sum(least(reached, last) - span_start + 1)::BIGINT AS chars FROM o WHERE reached >= span_start GROUP BY path, chunk_index""")
def range_overlaps(spark, sf_dir):
    """Spans of scenes that overlap an earlier span of the same chunk."""
    refs = table(spark, sf_dir, "plot_chunks").select("plot_chunk_id", F.explode("source_refs").alias("r")).distinct()
    spans = refs.select("plot_chunk_id", "r.path", "r.chunk_index", "r.span_start", (F.col("r.span_end") - 1).alias("last"))
    over = S.range_overlaps(spans, ["path", "chunk_index"], "span_start", "last")
    return over.groupBy("path", "chunk_index").agg(F.count("*").alias("overlaps"), F.sum(F.least("reached", "last") - F.col("span_start") + 1).alias("chars"))


@query("""
    WITH u AS (SELECT DISTINCT utterance_id, book_key, plot_index, utterance_index, speaker, content FROM utterances),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_key, plot_index, speaker, content, utterance_index ORDER BY utterance_id) AS rn FROM u)
    SELECT utterance_id FROM r WHERE rn = 1 OR utterance_index IS NULL""")
def kept_first(spark, sf_dir):
    """Lines without later copies at the same place."""
    rows = table(spark, sf_dir, "utterances").select("utterance_id", "book_key", "plot_index", "utterance_index", "speaker", "content").distinct()
    return S.keep_first(rows, ["book_key", "plot_index", "speaker", "content"], "utterance_index", ["utterance_id"]).select("utterance_id")


@query(f"""
    WITH l AS (SELECT *, coalesce(speaker, '') || ':' || coalesce(content, '') AS line FROM {_LINES}),
    h AS (SELECT utterance_id, list(line) OVER (PARTITION BY conversation_id ORDER BY utterance_index, utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM l)
    SELECT utterance_id, coalesce(len(h), 0)::INT AS before, md5(coalesce(list_aggregate(h, 'string_agg', chr(10)), '')) AS history_md5 FROM h""")
def history_prefix(spark, sf_dir):
    """What was said before each line, as a fingerprint."""
    out = S.history_prefix(lines(spark, sf_dir), ["conversation_id"], ["utterance_index", "utterance_id"], F.concat(F.coalesce("speaker", F.lit("")), F.lit(":"), F.coalesce("content", F.lit(""))))
    n = F.row_number().over(S._ordered(["conversation_id"], ["utterance_index", "utterance_id"])) - 1
    return out.select("utterance_id", n.alias("before"), F.md5("history").alias("history_md5"))


_STATE = "(SELECT event_id, user_id, ts, event_type, value FROM events)"


@query("""
    WITH m AS (SELECT event_id, user_id, ts FROM events), t AS (SELECT DISTINCT user_id, event_type FROM events),
    q AS (SELECT m.*, t.event_type FROM m JOIN t USING (user_id))
    SELECT q.event_id, q.event_type AS state, e.value AS value FROM q ASOF JOIN events e ON q.user_id = e.user_id AND q.event_type = e.event_type AND q.ts >= e.ts""")
def state_snapshot(spark, sf_dir):
    """The value of every state of a stream's key at each of its events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    asked = events.select("event_id", "user_id", "ts")
    out = state.snapshot_asof(asked, events.drop("event_id"), ["user_id"], "ts", "event_type", "value", "event_id")
    return out.select("event_id", F.col("event_type").alias("state"), "value")


@query("""
    WITH b AS (SELECT event_id, user_id, event_type, ts, round(value) AS after, lag(round(value), 2, round(value)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
    k AS (SELECT *, lag(after) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS known FROM b)
    SELECT event_id, known, CASE WHEN before IS NOT DISTINCT FROM after THEN 'no-op' WHEN known IS NOT NULL AND known IS DISTINCT FROM before THEN 'mismatch' END AS issue FROM k""")
def timeline_issues(spark, sf_dir):
    """Changes that change nothing, or start from another value than the last known."""
    w = S._ordered(["user_id", "event_type"], ["ts", "event_id"])
    events = table(spark, sf_dir, "events").withColumn("after", F.round("value")).withColumn("before", F.coalesce(F.lag("after", 2).over(w), F.col("after")))
    return state.timeline_issues(events, ["user_id"], ["ts", "event_id"], "event_type", "before", "after").select("event_id", "known", "issue")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS carried_click, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS carried_purchase
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def carried_state(spark, sf_dir):
    """The last known values of two states before each event."""
    events = table(spark, sf_dir, "events")
    return S.carried(events, ["user_id"], ["ts", "event_id"], "event_type", "value", ["click", "purchase"]).select("event_id", "carried_click", "carried_purchase")


@query("""
    WITH m AS (SELECT min(message_id) AS message_id, chat_session_id, sender_role, content, created_at FROM chat_messages WHERE kind = 'message' AND include_in_context GROUP BY ALL),
    t AS (SELECT *, sum(CASE WHEN sender_role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_session_id ORDER BY created_at, message_id) AS turn, coalesce(length(content), 0) AS n FROM m),
    g AS (SELECT chat_session_id, turn, sum(n) AS turn_n FROM t GROUP BY ALL),
    s AS (SELECT *, sum(turn_n) OVER (PARTITION BY chat_session_id ORDER BY turn DESC) AS total FROM g)
    SELECT t.message_id, t.turn::BIGINT AS turn FROM t JOIN s USING (chat_session_id, turn) WHERE total <= 180""")
def trimmed_context(spark, sf_dir):
    """The newest whole turns of each chat within 180 code points."""
    rows = table(spark, sf_dir, "chat_messages").filter("kind = 'message' and include_in_context")
    once = rows.groupBy("chat_session_id", "sender_role", "content", "created_at").agg(F.min("message_id").alias("message_id"))
    out = S.trim_context(once, ["chat_session_id"], ["created_at", "message_id"], F.length("content"), F.col("sender_role") == "user", 180)
    return out.select("message_id", "turn")


@query(f"""
    WITH c AS (SELECT book_key, chunk_index, chunk_id, section FROM {_CHUNKS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY chunk_index, chunk_id) - 1 AS at_, count(*) OVER (PARTITION BY book_key) AS total, lag(section) OVER (PARTITION BY book_key ORDER BY chunk_index, chunk_id) AS before FROM c),
    s AS (SELECT DISTINCT book_key, at_, total FROM r WHERE before IS NULL OR before <> section UNION SELECT DISTINCT book_key, 0, total FROM r)
    SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY at_) - 1 AS chapter, at_ AS first_page, coalesce(lead(at_) OVER (PARTITION BY book_key ORDER BY at_), total) AS end_page FROM s""")
def chapter_intervals(spark, sf_dir):
    """Pages of each chapter, from the pages on which the section changes."""
    from pyspark.sql import Window as W

    c = chunks(spark, sf_dir)
    w = W.partitionBy("book_key").orderBy("chunk_index", "chunk_id")
    placed = c.select("book_key", (F.row_number().over(w) - 1).alias("page"), F.count("*").over(W.partitionBy("book_key")).alias("total"), "section", F.lag("section").over(w).alias("before"))
    starts = placed.filter("before is null or before <> section").select("book_key", "page", "total")
    return S.intervals(starts, ["book_key"], "page", "total").select("book_key", F.col("interval").cast("bigint").alias("chapter"), F.col("start").cast("bigint").alias("first_page"), F.col("end").cast("bigint").alias("end_page"))


@query(f"""
    WITH f AS (SELECT conversation_id, speaker, min((utterance_index, utterance_id)) AS first FROM {_LINES} WHERE speaker IS NOT NULL GROUP BY ALL)
    SELECT conversation_id, speaker, (row_number() OVER (PARTITION BY conversation_id ORDER BY first, speaker) - 1)::INT AS place FROM f""")
def speaker_places(spark, sf_dir):
    """Speakers numbered by their first line."""
    return S.first_appearance(lines(spark, sf_dir), ["conversation_id"], ["utterance_index", "utterance_id"], "speaker")


@query(f"""
    WITH c AS (SELECT book_key, chunk_index, chunk_id, string_split(section, '|')[1] AS volume FROM {_CHUNKS}),
    m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(volume) OVER w = volume THEN 0 ELSE 1 END AS c FROM c WINDOW w AS (PARTITION BY book_key ORDER BY chunk_index, chunk_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY book_key ORDER BY chunk_index, chunk_id) AS run FROM m)
    SELECT book_key, run::BIGINT AS run, volume, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk, count(*) AS chunks FROM r GROUP BY book_key, run, volume""")
def volume_runs(spark, sf_dir):
    """Regions of successive chunks of one volume."""
    c = chunks(spark, sf_dir).withColumn("volume", F.split("section", r"\|")[0])
    return S.runs(c, ["book_key"], ["chunk_index", "chunk_id"], F.col("volume")).groupBy("book_key", "run", "volume").agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"), F.count("*").alias("chunks"))


@query(f"""
    SELECT plot_chunk_id, (sum(length(text)) OVER w - length(text))::BIGINT AS offset_start, (sum(length(text)) OVER w)::BIGINT AS offset_end
    FROM {_PLOT} WINDOW w AS (PARTITION BY book_key, plot_index ORDER BY chunk_index, plot_chunk_id)""")
def offset_sums(spark, sf_dir):
    """Where each scene chunk lies in its scene."""
    return S.offset_sums(plot_chunks(spark, sf_dir), ["book_key", "plot_index"], ["chunk_index", "plot_chunk_id"], F.length("text")).select("plot_chunk_id", "offset_start", "offset_end")


@query("""
    WITH v AS (SELECT DISTINCT candidate_id, validations FROM candidates), e AS (SELECT candidate_id, unnest(range(len(validations))) AS pos, unnest(validations) AS v FROM v),
    a AS (SELECT candidate_id, v.name AS name, pos, v.value.canonical AS value FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, name ORDER BY pos) AS k FROM a),
    r AS (SELECT candidate_id, name, pos, 'fixed-' || k AS value FROM n WHERE value IS NULL OR pos = 0 UNION ALL SELECT candidate_id, name, 1000 + pos, 'extra-' || k FROM n WHERE pos % 2 = 0 UNION ALL SELECT candidate_id, 'unseen', 2000, 'extra' FROM n WHERE pos = 1),
    q AS (SELECT candidate_id, name, pos AS at, value AS fixed, row_number() OVER (PARTITION BY candidate_id, name ORDER BY pos) AS k FROM r)
    SELECT candidate_id, name, coalesce(q.fixed, n.value) AS value, coalesce(n.pos, q.at)::INT AS pos, q.fixed IS NOT NULL AS repaired, n.pos IS NULL AS appended
    FROM n FULL JOIN q USING (candidate_id, name, k)""")
def repaired_nodes(spark, sf_dir):
    """Checks replaced by repairs, the k-th of a name by the k-th; repairs beyond the checks are appended."""
    from pyspark.sql import Window as W

    nodes = table(spark, sf_dir, "candidates").select("candidate_id", "validations").distinct().select("candidate_id", F.posexplode("validations").alias("pos", "v")).select("candidate_id", "v.name", "pos", F.col("v.value.canonical").alias("value"))
    k = F.row_number().over(W.partitionBy("candidate_id", "name").orderBy("pos"))
    counted = nodes.withColumn("k", k)
    fixed = counted.filter("value is null or pos = 0").select("candidate_id", "name", "pos", F.concat(F.lit("fixed-"), F.col("k").cast("string")).alias("value"))
    extra = counted.filter("pos % 2 = 0").select("candidate_id", "name", (F.col("pos") + 1000).alias("pos"), F.concat(F.lit("extra-"), F.col("k").cast("string")).alias("value"))
    unseen = counted.filter("pos = 1").select("candidate_id", F.lit("unseen").alias("name"), F.lit(2000).alias("pos"), F.lit("extra").alias("value"))
    repairs = fixed.unionByName(extra).unionByName(unseen)
    return S.repair_nodes(nodes, repairs, ["candidate_id"], "name", "pos", "value")


@query("""
    WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, string_agg(event_type, '>' ORDER BY ts, event_id) AS source FROM events GROUP BY ALL),
    b AS (SELECT user_id, day, source FROM e UNION ALL SELECT user_id, day, right(source, 5) FROM e UNION ALL SELECT user_id, day, left(source, 5) FROM e WHERE user_id % 2 = 0),
    o AS (SELECT user_id, day, arg_max(source, (length(source), source)) AS "outer" FROM b GROUP BY ALL)
    SELECT user_id, day, o."outer", count(*) AS n, bool_and(suffix(o."outer", b.source)) AS related FROM b JOIN o USING (user_id, day) GROUP BY ALL""")
def transition_groups(spark, sf_dir):
    """Changes of one day as one group under the longest source, and whether all others end it; some here do not."""
    events = table(spark, sf_dir, "events")
    daily = events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(S.joined_in_order(["ts", "event_id"], F.col("event_type"), ">").alias("source"))
    both = daily.unionByName(daily.withColumn("source", F.expr("right(source, 5)"))).unionByName(daily.filter("user_id % 2 = 0").withColumn("source", F.expr("left(source, 5)")))
    return state.transition_groups(both, ["user_id"], "day", "source")
