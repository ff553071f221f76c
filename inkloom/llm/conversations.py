"""Problem 4: rebuilding conversations from message rows, and dropping the unusable ones.

Rows without a conversation are put together as components over reply links
(a tool's answer to a call), quote links (lines after ``>`` that repeat a whole
message) and links of a message to itself, delivered again.  A link that more
than one conversation could answer is none.  Ordering doesn't gather a conversation: rows are range
partitioned by conversation and time, so that a hot one lies in many
partitions; each partition sums up its part of every conversation, and the
parts, at most one per partition, are folded in order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.operators.components import components
from inkloom.session import cut, table

ROLES = ["user", "assistant", "tool", "system"]
#: A block of lines after ``>``, and the marks before them.
QUOTED, QUOTE_MARK = r"(?m)(?:^[ \t]*>[^\n]*(?:\n|\z))+", r"(?m)^[ \t]*>[ \t]?"
NARRATOR = "Environment"


def visible(text: Column) -> Column:
    """Whether a text has a visible character; false for null."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}\p{C}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{2800}]"), F.lit(False))


def _digest(text: Column) -> Column:
    """A key for texts that are equal but for line ends and blanks around them."""
    return F.md5(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _node(session: Column, row: Column) -> Column:
    """An even number for a known conversation, an odd one for a row without; ids beyond 2**62 raise."""
    return F.when(session.isNull(), row.cast("bigint") * 2 + 1).otherwise(session.cast("bigint") * 2)


def links(messages: DataFrame) -> DataFrame:
    """``a, b``: ids of messages of one conversation, of which at least one lacks its ``chat_session_id``.

    A link comes from a key that one side names (a call's id, a quoted text)
    and the other side bears.  Bearers are counted by conversation, rows
    without one each by itself, after equal ones (role, content and time) are
    taken together: where several bear the key, the key links nothing.
    """
    slim = messages.filter(F.col("message_id").isNotNull()).select("message_id", "content", "tool_calls_json", "tool_call_id", "chat_session_id", "sender_role", "created_at")
    lost = F.col("chat_session_id").isNull()
    # Equal rows without a conversation are one message.
    again = slim.filter(lost & F.col("content").isNotNull() & F.col("created_at").isNotNull()).groupBy(F.xxhash64("sender_role", "content", "created_at").alias("_h"), "sender_role", "created_at", F.md5("content").alias("_d"))
    first = again.agg(F.min("message_id").alias("one"), F.collect_set("message_id").alias("ids")).filter(F.size("ids") > 1).select("one", F.explode("ids").alias("message_id"))
    same = first.filter("one <> message_id").select(F.col("one").alias("a"), F.col("message_id").alias("b"))
    first = cut(first, "again")
    owned = slim.join(first, "message_id", "left").withColumn("owner", _node(F.col("chat_session_id"), F.coalesce("one", "message_id"))).withColumn("lost", lost)
    calls = F.regexp_extract_all("tool_calls_json", F.lit(r'"id"\s*:\s*"([^"]+)"'), F.lit(1))
    blocks = F.transform(F.regexp_extract_all("content", F.lit(QUOTED), F.lit(0)), lambda q: _digest(F.regexp_replace(q, QUOTE_MARK, "")))
    # The keys that rows bear, and those they name.
    text = F.when(visible(F.col("content")), _digest(F.col("content")))
    bears = owned.select("message_id", "owner", "lost", F.explode(F.array_distinct(F.concat(F.transform(F.coalesce(calls, F.array().cast("array<string>")), lambda c: F.concat(F.lit("c"), c)), F.array_compact(F.array(F.concat(F.lit("q"), text)))))).alias("key"))
    names = owned.select("message_id", "owner", "lost", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(F.concat(F.lit("c"), F.col("tool_call_id")))), F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda c: F.concat(F.lit("q"), c))))).alias("key"))
    # Only keys of rows without a conversation can link; written first, so that their size is known before all rows meet them.
    asked = cut(bears.filter("lost").select("key").unionByName(names.filter("lost").select("key")).distinct(), "keys")
    single = bears.join(asked, "key", "left_semi").groupBy("key").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.min("message_id").alias("b"), F.min("lost").alias("b_lost")).filter("lo = hi").select("key", "b", "b_lost", F.col("lo").alias("b_owner"))
    found = names.join(asked, "key", "left_semi").join(single, "key").filter("owner <> b_owner and (lost or b_lost)").select(F.col("message_id").alias("a"), "b")
    return found.unionByName(same)


def identify(messages: DataFrame) -> DataFrame:
    """Give every row without ``chat_session_id`` one: the known one of its component, else minus its least message id, minus one.

    A component with several known conversations proves none of them: its rows
    without one stay together under a number of their own.
    """
    joined = cut(links(messages), "links")
    lost = messages.filter(F.col("chat_session_id").isNull() & F.col("message_id").isNotNull()).select(F.col("message_id").cast("bigint").alias("a"), F.col("message_id").cast("bigint").alias("b"))
    # A known conversation is one node, so that its rows aren't linked one by one.
    ends = cut(joined.select(F.col("a").alias("message_id")).unionByName(joined.select(F.col("b").alias("message_id"))).distinct(), "ends")
    known = cut(messages.filter(F.col("chat_session_id").isNotNull()).select("message_id", "chat_session_id").join(ends, "message_id", "left_semi").distinct(), "known")
    sides = joined.join(known.select(F.col("message_id").alias("a"), F.col("chat_session_id").alias("_sa")), "a", "left").join(known.select(F.col("message_id").alias("b"), F.col("chat_session_id").alias("_sb")), "b", "left")
    own = lost.select(_node(F.lit(None), F.col("a")).alias("a"), _node(F.lit(None), F.col("b")).alias("b"))
    parts = cut(components(sides.select(_node(F.col("_sa"), F.col("a")).alias("a"), _node(F.col("_sb"), F.col("b")).alias("b")).unionByName(own)), "sessions").withColumns({"row": F.pmod("node", F.lit(2)) == 1, "id": F.expr("(node - pmod(node, 2)) div 2")})
    facts = parts.groupBy("component").agg(F.min(F.when(~F.col("row"), F.col("id"))).alias("lo"), F.max(F.when(~F.col("row"), F.col("id"))).alias("hi"), F.min(F.when(F.col("row"), F.col("id"))).alias("first"))
    found = parts.filter("row").join(facts, "component").select(F.col("id").alias("message_id"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.col("first") - 1).alias("found"))
    # Written first as well: all messages meet it, and it holds only the rows that lacked a conversation.
    found = cut(found, "found")
    return messages.join(found, "message_id", "left").withColumn("chat_session_id", F.coalesce("chat_session_id", "found")).drop("found").select(*messages.columns)


def messages_once(messages: DataFrame) -> DataFrame:
    """One row per message: same conversation, role, content and time; the least id stays."""
    return messages.groupBy("chat_session_id", "sender_role", "content", "created_at").agg(F.min("message_id").alias("message_id"), F.min_by("kind", "message_id").alias("kind"))


def _parts(batches):
    """Sum up each conversation's rows in this partition; a part is one row."""
    number = TaskContext.get().partitionId()
    out: list[tuple] = []
    now: list | None = None
    for batch in batches:
        for session, user, shown in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if now is None or now[0] != session:
                if now is not None:
                    out.append(tuple(now))
                # session, part, first is the user's, has a user row, answered before it, an unanswered one, the last is unanswered
                now = [session, number, user, False, False, False, False]
            if user:
                now[5] |= now[3] and now[6]
                now[3], now[6] = True, True
            elif shown:
                if now[3]:
                    now[6] = False
                else:
                    now[4] = True
    if now is not None:
        out.append(tuple(now))
    names = ["chat_session_id", "part", "first_user", "any_user", "head", "bad", "open"]
    kinds = [pa.int64(), pa.int32(), *[pa.bool_()] * 5]
    columns = list(zip(*out)) if out else [[]] * 7
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def broken_sessions(messages: DataFrame) -> DataFrame:
    """``chat_session_id`` of the sessions to drop, from rows that are one per message."""
    talk = F.col("sender_role").isin("user", "assistant") & (F.col("kind") == "message")
    talk = F.coalesce(talk, F.lit(False))
    facts = messages.groupBy("chat_session_id").agg(F.max(~F.coalesce(F.col("sender_role").isin(ROLES), F.lit(False))).alias("bad_role"), F.max(talk & visible(F.col("content"))).alias("said"))
    turns = messages.filter(talk).select("chat_session_id", (F.col("sender_role") == "user").alias("user"), visible(F.col("content")).alias("shown"), "created_at", "message_id")
    parts = _in_order(turns, "chat_session_id", "created_at", "message_id").select("chat_session_id", "user", "shown").mapInArrow(_parts, "chat_session_id bigint, part int, first_user boolean, any_user boolean, head boolean, bad boolean, open boolean")
    # At most one part per partition and session, folded in order.
    listed = parts.groupBy("chat_session_id").agg(F.sort_array(F.collect_list(F.struct("part", "first_user", "any_user", "head", "bad", "open"))).alias("parts"))
    start = F.struct(F.lit(False).alias("bad"), F.lit(False).alias("open"))
    fold = F.aggregate("parts", start, lambda s, p: F.struct((s["bad"] | p["bad"] | (s["open"] & ~p["head"] & p["any_user"])).alias("bad"), F.when(p["any_user"], p["open"]).otherwise(s["open"] & ~p["head"]).alias("open")))
    judged = listed.select("chat_session_id", (~F.col("parts")[0]["first_user"]).alias("late"), fold.alias("end"))
    out = facts.join(judged, facts["chat_session_id"].eqNullSafe(judged["chat_session_id"]), "left").drop(judged["chat_session_id"])
    return out.filter(F.col("bad_role") | ~F.col("said") | F.coalesce(F.col("late"), F.lit(True)) | F.col("end.bad") | F.col("end.open")).select("chat_session_id")


def lines_once(utterances: DataFrame) -> DataFrame:
    """One row per line: same conversation, index, speaker and content; the least id stays."""
    return utterances.groupBy("conversation_id", "utterance_index", "speaker", "content").agg(F.min("utterance_id").alias("utterance_id"))


def broken_plots(lines: DataFrame) -> DataFrame:
    """``conversation_id`` of the conversations of a plot to drop, from rows that are one per line."""
    speaker = F.when((F.col("speaker") != NARRATOR) & visible(F.col("speaker")), F.col("speaker"))
    # First by line number, so that no conversation's rows meet in one task before they are few.
    by_index = lines.groupBy("conversation_id", "utterance_index").agg(F.count("*").alias("n"), F.min(visible(F.col("speaker")) & visible(F.col("content"))).alias("shown"))
    facts = by_index.groupBy("conversation_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("utterance_index").alias("lo"), F.max("utterance_index").alias("hi"), F.max(F.col("utterance_index").isNull()).alias("lost"), F.min("shown").alias("shown"))
    voices = lines.select("conversation_id", speaker.alias("speaker")).filter("speaker is not null").distinct().groupBy("conversation_id").agg(F.count("*").alias("voices"))
    out = facts.join(voices, "conversation_id", "left")
    whole = (F.col("most") == 1) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & ~F.col("lost")
    return out.filter(~F.coalesce(whole, F.lit(False)) | ~F.col("shown") | (F.coalesce("voices", F.lit(0)) < 2)).select("conversation_id")


def p4_found(spark, sf_dir: str) -> DataFrame:
    chat = broken_sessions(messages_once(identify(table(spark, sf_dir, "chat_messages"))))
    plot = broken_plots(lines_once(table(spark, sf_dir, "utterances").filter("conversation_id is not null")))
    out = chat.select(F.lit("chat").alias("conversation_kind"), F.col("chat_session_id").alias("conversation_id"))
    return out.unionByName(plot.select(F.lit("plot").alias("conversation_kind"), "conversation_id"))


def _number(batches):
    """Rows of this partition in their order, each with its place among its conversation's rows here."""
    number = TaskContext.get().partitionId()
    last, at = object(), 0
    for batch in batches:
        places = []
        for session in batch.column(0).to_pylist():
            at = at + 1 if session == last else 0
            last = session
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([number] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])


def ordered_chat(messages: DataFrame) -> DataFrame:
    """``conversation_id, position, speaker, content`` of the sessions that stay, positions from 0 by time and id."""
    once = cut(messages_once(messages), "messages")
    kept = once.join(broken_sessions(once), "chat_session_id", "left_anti").filter("kind = 'message'")
    rows = _in_order(kept.select("chat_session_id", "created_at", "message_id", "sender_role", "content"), "chat_session_id", "created_at", "message_id")
    numbered = cut(rows.mapInArrow(_number, "chat_session_id bigint, created_at timestamp, message_id bigint, sender_role string, content string, part int, place bigint"), "numbered")
    sizes = numbered.groupBy("chat_session_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("chat_session_id").orderBy("part")) - F.col("n")).drop("n")
    return numbered.join(before, ["chat_session_id", "part"]).select(F.col("chat_session_id").alias("conversation_id"), (F.col("place") + F.col("before")).alias("position"), F.col("sender_role").alias("speaker"), "content")


def p4_conversations(spark, sf_dir: str) -> DataFrame:
    """The lines of all usable conversations in order."""
    chat = ordered_chat(identify(table(spark, sf_dir, "chat_messages")))
    lines = lines_once(table(spark, sf_dir, "utterances").filter("conversation_id is not null"))
    plot = lines.join(broken_plots(lines), "conversation_id", "left_anti").select(F.lit("plot").alias("conversation_kind"), "conversation_id", F.col("utterance_index").cast("bigint").alias("position"), "speaker", "content")
    return chat.select(F.lit("chat").alias("conversation_kind"), "conversation_id", "position", "speaker", "content").unionByName(plot)
