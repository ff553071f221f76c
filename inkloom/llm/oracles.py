"""DuckDB SQL for the queries that SQL can express."""

_SPLIT_GROUPS = """
        WITH RECURSIVE c AS (SELECT DISTINCT candidate_id, book_key, plot_index, CASE WHEN character_name <> 'Unknown' THEN character_name END AS name FROM candidates),
        s AS (SELECT DISTINCT book_key, plot_index FROM c WHERE book_key IS NOT NULL AND plot_index IS NOT NULL),
        link AS (SELECT DISTINCT a.book_key AS b1, a.plot_index AS p1, z.book_key AS b2, z.plot_index AS p2 FROM c a JOIN c z ON a.name = z.name),
        reach AS (
            SELECT book_key AS b1, plot_index AS p1, book_key AS b2, plot_index AS p2 FROM s
            UNION
            SELECT reach.b1, reach.p1, link.b2, link.p2 FROM reach JOIN link ON reach.b2 = link.b1 AND reach.p2 = link.p1),
        least AS (SELECT b1, p1, min(struct_pack(b := b2, p := p2)) AS g FROM reach GROUP BY b1, p1)
        SELECT DISTINCT candidate_id, g.b AS group_book_key, g.p AS group_plot_index{} FROM c JOIN least ON c.book_key = b1 AND c.plot_index = p1"""
#: All spans of the threshold that two documents hold, and where they begin.
_SPANS = """
        WITH t AS (SELECT setting_value AS n FROM size_limits WHERE setting_name = 'shared_span_chars'),
        w AS (SELECT doc_id, i, md5(substr(text, i::BIGINT, n)) AS s FROM (SELECT doc_id, text, n, unnest(generate_series(1, length(text) - n + 1)) AS i FROM documents, t WHERE length(text) >= n)),
        m AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        h AS (SELECT w.* FROM w SEMI JOIN m ON w.s = m.s)"""

ORACLES = {
    "p2_members": _SPLIT_GROUPS.format(", 1::BIGINT AS splits, 1::BIGINT AS splits_of_group"),
    "p7_cover": """
        WITH i AS (SELECT DISTINCT 'text_chunk' AS item_kind, chunk_id AS item_id, text FROM text_chunks UNION SELECT DISTINCT 'plot_chunk', plot_chunk_id, text FROM plot_chunks)
        SELECT item_kind, item_id, length(text)::BIGINT AS chars, md5(text) AS text_md5, true AS fits, true AS overlaps FROM i WHERE length(text) > (SELECT setting_value FROM size_limits WHERE setting_name = 'chunk_limit_chars')""",
    "p9_placed": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> ''",
    "p10_found": _SPANS + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id",
    "p10_shared": _SPANS + """,
        u AS (SELECT doc_id, sum(least((SELECT n FROM t), coalesce(nxt - i, (SELECT n FROM t)))) AS c FROM (SELECT DISTINCT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h) GROUP BY 1)
        SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c, 0)::BIGINT AS shared_chars, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE coalesce(c, 0) / length(text)::DOUBLE END AS shared_share FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id""",
    "p7_found": """
        SELECT DISTINCT 'text_chunk' AS item_kind, chunk_id AS item_id FROM text_chunks WHERE length(text) > (SELECT setting_value FROM size_limits WHERE setting_name = 'chunk_limit_chars')
        UNION ALL
        SELECT DISTINCT 'plot_chunk', plot_chunk_id FROM plot_chunks WHERE length(text) > (SELECT setting_value FROM size_limits WHERE setting_name = 'chunk_limit_chars')""",
    "p2_found": _SPLIT_GROUPS.format(""),
    "p4_found": r"""
        WITH m AS (
            SELECT chat_session_id AS s, sender_role AS r, content AS t, created_at AS w, min(message_id) AS id, arg_min(kind, message_id) AS k
            FROM chat_messages GROUP BY ALL),
        v AS (SELECT *, coalesce(regexp_matches(t, '[^\s\pZ\pC]'), false) AS shown, r IN ('user', 'assistant') AND k = 'message' AS talk FROM m),
        n AS (SELECT *, sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY w, id) AS turn FROM v WHERE talk),
        turns AS (SELECT s, turn, bool_or(r = 'assistant' AND shown) AS answered FROM n GROUP BY s, turn),
        bad AS (SELECT s FROM turns GROUP BY s HAVING min(turn) = 0 OR bool_or(NOT answered)),
        chat AS (SELECT s FROM v GROUP BY s HAVING bool_or(coalesce(r NOT IN ('user', 'assistant', 'tool', 'system'), true)) OR NOT coalesce(bool_or(talk AND shown), false)),
        l AS (SELECT DISTINCT conversation_id AS c, utterance_index AS i, speaker AS p, content AS t FROM utterances),
        plot AS (
            SELECT c FROM l GROUP BY c
            HAVING count(*) <> count(DISTINCT i) OR min(i) <> 0 OR max(i) <> count(*) - 1
                OR bool_or(NOT coalesce(regexp_matches(p, '[^\s\pZ\pC]'), false) OR NOT coalesce(regexp_matches(t, '[^\s\pZ\pC]'), false))
                OR count(DISTINCT CASE WHEN p <> 'Environment' AND regexp_matches(p, '[^\s\pZ\pC]') THEN p END) < 2)
        SELECT 'chat' AS conversation_kind, s AS conversation_id FROM (SELECT s FROM bad UNION SELECT s FROM chat)
        UNION ALL SELECT 'plot', c FROM plot""",
    "p4_conversations": r"""
        WITH m AS (
            SELECT chat_session_id AS s, sender_role AS r, content AS t, created_at AS w, min(message_id) AS id, arg_min(kind, message_id) AS k
            FROM chat_messages GROUP BY ALL),
        v AS (SELECT *, coalesce(regexp_matches(t, '[^\s\pZ\pC]'), false) AS shown, r IN ('user', 'assistant') AND k = 'message' AS talk FROM m),
        n AS (SELECT *, sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY w, id) AS turn FROM v WHERE talk),
        turns AS (SELECT s, turn, bool_or(r = 'assistant' AND shown) AS answered FROM n GROUP BY s, turn),
        bad AS (SELECT s FROM turns GROUP BY s HAVING min(turn) = 0 OR bool_or(NOT answered)),
        chat AS (SELECT s FROM v GROUP BY s HAVING bool_or(coalesce(r NOT IN ('user', 'assistant', 'tool', 'system'), true)) OR NOT coalesce(bool_or(talk AND shown), false)),
        l AS (SELECT DISTINCT conversation_id AS c, utterance_index AS i, speaker AS p, content AS t FROM utterances),
        plot AS (
            SELECT c FROM l GROUP BY c
            HAVING count(*) <> count(DISTINCT i) OR min(i) <> 0 OR max(i) <> count(*) - 1
                OR bool_or(NOT coalesce(regexp_matches(p, '[^\s\pZ\pC]'), false) OR NOT coalesce(regexp_matches(t, '[^\s\pZ\pC]'), false))
                OR count(DISTINCT CASE WHEN p <> 'Environment' AND regexp_matches(p, '[^\s\pZ\pC]') THEN p END) < 2),
        gone AS (SELECT s FROM bad UNION SELECT s FROM chat),
        once AS (SELECT conversation_id AS c, utterance_index AS i, speaker AS p, content AS t FROM utterances GROUP BY ALL)
        SELECT 'chat' AS conversation_kind, s AS conversation_id, row_number() OVER (PARTITION BY s ORDER BY w, id) - 1 AS position, r AS speaker, t AS content FROM v WHERE k = 'message' AND s NOT IN (SELECT s FROM gone) AND s NOT IN (SELECT s FROM v GROUP BY s HAVING count(*) FILTER (WHERE talk) = 0)
        UNION ALL SELECT 'plot', c, i, p, t FROM once WHERE c NOT IN (SELECT c FROM plot)""",
}
