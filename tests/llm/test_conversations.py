import datetime as dt

from inkloom.llm.conversations import broken_plots, broken_sessions, identify, lines_once, messages_once, ordered_chat

CHAT = "message_id bigint, chat_session_id bigint, sender_role string, content string, kind string, tool_calls_json string, tool_call_id string, created_at timestamp, position string"


def message(i, session, role, content, at=None, kind="message", calls=None, call=None):
    return (i, session, role, content, kind, calls, call, dt.datetime(2025, 1, 1, 0, 0, at if at is not None else i % 60), "clash")


def test_sessions(spark):
    rows = [
        message(1, 1, "user", "hi"), message(2, 1, "assistant", "yes"), message(2, 1, "assistant", "yes"),
        message(3, 2, "user", "hi"), message(4, 2, "assistant", " ​"),
        message(5, 3, "assistant", "hello"), message(6, 3, "user", "hi"), message(7, 3, "assistant", "yes"),
        message(8, 4, "user", "a"), message(9, 4, "user", "b"), message(10, 4, "assistant", "c"),
        message(11, 5, "user", "a"), message(12, 5, "assistant", None), message(13, 5, "tool", "x"), message(14, 5, "assistant", "c"),
        message(15, 6, "usr", "a"), message(16, 6, "user", "a"), message(17, 6, "assistant", "b"),
        message(18, 7, "assistant", "note", kind="event"),
        message(20, 8, "user", "a", at=5), message(19, 8, "assistant", "b", at=6), message(22, 8, "user", "a", at=5),
        message(23, 9, None, "a"), message(24, 9, "user", "a"), message(25, 9, "assistant", "b"),
        message(26, 10, "user", "q", at=1), message(27, 10, "assistant", "r", at=1),
    ]
    once = messages_once(spark.createDataFrame(rows, CHAT))
    bad = {r["chat_session_id"] for r in broken_sessions(once).collect()}
    assert bad == {2, 3, 4, 6, 7, 9}
    kept = ordered_chat(spark.createDataFrame(rows, CHAT)).orderBy("conversation_id", "position").collect()
    assert [(r["conversation_id"], r["position"], r["content"]) for r in kept if r["conversation_id"] in (1, 8)] == [(1, 0, "hi"), (1, 1, "yes"), (8, 0, "a"), (8, 1, "b")]


def test_a_hot_session_over_many_partitions(spark):
    rows = [(i, 1, "user" if i % 2 == 0 else "assistant", f"m{i}", "message", None, None, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i), "") for i in range(600)]
    once = messages_once(spark.createDataFrame(rows, CHAT))
    assert broken_sessions(once).collect() == []
    cut = messages_once(spark.createDataFrame(rows[:300] + rows[301:], CHAT))
    assert broken_sessions(cut).collect() == []
    cut = messages_once(spark.createDataFrame(rows[:301] + rows[302:], CHAT))
    assert len(broken_sessions(cut).collect()) == 1
    ordered = ordered_chat(spark.createDataFrame(rows, CHAT)).orderBy("position").collect()
    assert [r["content"] for r in ordered] == [f"m{i}" for i in range(600)]
    assert [r["position"] for r in ordered] == list(range(600))


def test_rows_without_a_session_are_linked(spark):
    rows = [message(1, None, "assistant", "", calls='[{"id": "call_7", "name": "x"}]'), message(2, None, "tool", "done", call="call_7"), message(3, 9, "user", "where is the old ladder?"), message(4, None, "assistant", "> where is the old ladder?\nhere"), message(5, None, "user", "alone")]
    got = {r["message_id"]: r["chat_session_id"] for r in identify(spark.createDataFrame(rows, CHAT)).collect()}
    assert got[4] == 9 and got[1] == got[2] < 0 and got[5] < 0 and got[5] != got[1]


def test_ambiguous_quotes_link_nothing(spark):
    rows = [message(1, 10, "assistant", "Yes, of course we can."), message(2, 20, "assistant", "Yes, of course we can."), message(3, None, "user", "> Yes, of course we can.\nthen do"), message(4, 30, "assistant", "First line\nsecond line"), message(5, None, "user", "> First line\n> second line\nthanks\n> no such text"), message(6, None, "user", "> ok\nfine"), message(7, 40, "assistant", "ok")]
    got = {r["message_id"]: r["chat_session_id"] for r in identify(spark.createDataFrame(rows, CHAT)).collect()}
    assert got[3] < 0 and got[5] == 30 and got[6] == 40


def test_lost_sessions_of_the_tables_come_back(spark):
    """A tenth of the session ids is taken away from rows that answer, call or quote; most come back, hardly any to a wrong session."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.01/chat_messages.parquet").dropDuplicates(["message_id"])
    before = F.lag("content").over(W.partitionBy("chat_session_id").orderBy("created_at", "message_id"))
    drawn = F.pmod(F.xxhash64("message_id"), F.lit(100))
    # Only texts of one session are quoted here; what several hold must not link, as the test above shows.
    single = table.groupBy(F.trim("content").alias("_before")).agg(F.count_distinct("chat_session_id").alias("_n")).filter("_n = 1").select("_before", F.lit(True).alias("_single"))
    quoting = (F.col("sender_role") == "user") & F.coalesce("_single", F.lit(False)) & F.col("content").isNotNull() & F.coalesce(F.length("_before") > 0, F.lit(False))
    rows = table.withColumn("_before", F.trim(before)).join(single, "_before", "left").withColumn("content", F.when(quoting, F.concat(F.lit("> "), F.regexp_replace("_before", r"\n", "\n> "), F.lit("\n"), F.col("content"))).otherwise(F.col("content")))
    linked = quoting | F.col("tool_call_id").isNotNull()
    rows = rows.withColumn("true_session", F.col("chat_session_id")).withColumn("taken", linked & (drawn < 50))
    share = rows.agg(F.avg(F.col("taken").cast("double"))).first()[0]
    assert 0.08 < share < 0.2
    asked = rows.withColumn("chat_session_id", F.when(~F.col("taken"), F.col("chat_session_id"))).select(*table.columns)
    got = identify(asked).select("message_id", F.col("chat_session_id").alias("found")).join(rows.filter("taken").select("message_id", "true_session"), "message_id")
    facts = got.agg(F.count("*").alias("n"), F.sum((F.col("found") >= 0).cast("int")).alias("named"), F.sum((F.col("found") == F.col("true_session")).cast("int")).alias("right")).first()
    assert facts["right"] >= 0.95 * facts["named"] and facts["right"] >= 0.95 * facts["n"]


def test_plots(spark):
    good = [(1, 0, "A", "x"), (1, 1, "B", "y"), (1, 1, "B", "y"), (1, 2, "Environment", "*(z)*")]
    rows = [*good, (2, 0, "A", "x"), (2, 2, "B", "y"), (3, 0, "A", "x"), (3, 0, "B", "y"), (4, 0, "A", "x"), (4, 1, "Environment", "y"), (5, 0, "A", "x"), (5, 1, "B", " "), (6, 1, "A", "x"), (6, 2, "B", "y"), (7, None, "A", "x"), (7, 0, "B", "x"), (8, 0, None, "x"), (8, 1, "A", "x"), (8, 2, "B", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "utterance_id bigint, conversation_id bigint, utterance_index int, speaker string, content string")
    assert {r["conversation_id"] for r in broken_plots(lines_once(df)).collect()} == {2, 3, 4, 5, 6, 7, 8}


def test_no_messages(spark):
    empty = messages_once(spark.createDataFrame([], CHAT))
    assert broken_sessions(empty).collect() == []
    assert identify(spark.createDataFrame([], CHAT)).collect() == []
