import json

import pytest
from pyspark.sql import functions as F

from inkloom.sources import datasets as D


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"k": 1}\n\n{"k": 2, "x": 9}\r\n')
    rows = D.read_numbered(spark, str(tmp_path / "a.jsonl"), "k int").orderBy("line").collect()
    assert [(r["line"], r["value"]["k"]) for r in rows] == [(1, 1), (3, 2)]
    for bad in ('{"k": 1}\n{"k": \n', '{"k": 1}\n[1]\n'):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match="b.jsonl 2"):
            D.read_numbered(spark, str(tmp_path / "b.jsonl"), "k int").collect()


def test_keyed_results(spark):
    rows = [("c1", '{"nodes": [{"name": "A.x"}], "title": "t"}'), ("c2", '{"nodes": []}')]
    df = spark.createDataFrame(rows, "chunk string, result string")
    got = {r["chunk"]: r["nodes"] for r in D.keyed_results(df, ["chunk"], "result", "nodes array<struct<name: string>>, title string").collect()}
    assert got["c1"][0]["name"] == "A.x" and got["c2"] == []
    for bad, what in ((rows + rows[:1], "two results"), ([(None, "{}")], "missing"), ([("c", None)], "malformed")):
        with pytest.raises(Exception, match=what):
            D.keyed_results(spark.createDataFrame(bad, "chunk string, result string"), ["chunk"], "result", "title string").collect()
    states = spark.createDataFrame([("t", 0, 1, [("A.x",), ("B.y",)])], "title string, plot_index int, chunk_index int, nodes array<struct<name: string>>")
    assert [(r["node_index"], r["name"]) for r in D.state_nodes(states, "t").collect()] == [(0, "A.x"), (1, "B.y")]
    with pytest.raises(Exception, match="another title"):
        D.state_nodes(states, "u").collect()


def test_matched_chunks(spark):
    chunks = spark.createDataFrame([(0, 0, "v", None, "text"), (0, 1, "v", "c", "more")], "p int, i int, volume string, chapter string, text string")
    good = spark.createDataFrame([(0, 0, "v", None)], "p int, i int, volume string, chapter string")
    assert D.matched_chunks(good, chunks, ["p", "i"], ["volume", "chapter"]).first()["text"] == "text"
    for row, what in (((0, 1, "v", None), "metadata differ"), ((3, 0, "v", None), "no such chunk")):
        with pytest.raises(Exception, match=what):
            D.matched_chunks(spark.createDataFrame([row], good.schema), chunks, ["p", "i"], ["volume", "chapter"]).collect()


def test_scene_texts_and_covered_lines(spark):
    chunks = spark.createDataFrame([(0, 0, "ab "), (0, 1, "cde"), (0, 2, "f"), (1, 1, "x"), (2, 0, "y")], "p int, i int, text string")
    covered = chunks.filter("not (p = 0 and i = 2) and p < 2")
    scenes = D.scene_texts(chunks, covered, ["p"], "i", "text")
    assert [(r["p"], r["chunks"], r["text"], r["normal"], r["starts"]) for r in scenes.collect()] == [(0, 2, "ab cde", "abcde", [0, 3])]
    lines = spark.createDataFrame([(0, 0, "a"), (0, 2, "b"), (5, 0, "c"), (0, None, "d")], "p int, i int, content string")
    kept, left = D.covered_lines(lines, scenes, ["p"], "i")
    assert [r["content"] for r in kept.collect()] == ["a"] and left.count() == 3 and left.filter(F.contains("message", F.lit("behind"))).count() == 2


def test_message_units(spark):
    kind = "id int, messages array<struct<role: string, content: string>>, data struct<messages: array<struct<role: string, content: string>>>"
    rows = [(1, [("system", "s"), ("user", "*(dawn)*\nAnn: hi\n\nstray"), ("assistant", "two\nlines")], None), (2, None, ([("user", "x")],))]
    got = D.message_units(spark.createDataFrame(rows, kind), ["id"]).orderBy("id", "message_index", "unit_index").collect()
    assert [(r["id"], r["message_index"], r["kind"], r["speaker"], r["content"]) for r in got] == [(1, 1, "narration", "Environment", "*(dawn)*"), (1, 1, "speech", "Ann", "hi"), (1, 1, "plain", "Environment", "stray"), (1, 2, "reply", None, "two\nlines"), (2, 0, "plain", "Environment", "x")]
    with pytest.raises(Exception, match="unknown role"):
        D.message_units(spark.createDataFrame([(1, [("tool", "x")], None)], kind), ["id"]).collect()


def test_documents_with_scenes(spark):
    doc = spark.createDataFrame([([(1, [("A", "x"), ("B", "y")]), (2, [])],)], "plots array<struct<plot_index: int, messages: array<struct<speaker: string, content: string>>>>")
    assert [(r["plot_index"], r["message_index"], r["content"]) for r in D.scene_messages(doc).collect()] == [(1, 0, "x"), (1, 1, "y")]
    twice = spark.createDataFrame([([(1, [("A", "x")]), (1, [("B", "y")])],)], "plots array<struct<plot_index: int, utterances: array<struct<speaker: string, content: string>>>>")
    with pytest.raises(Exception, match="two records"):
        D.nested_dialogues(twice).collect()


def test_episodes(spark, tmp_path):
    for name, ids in (("b", [3]), ("a", [1, 2]), ("out", [1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "episodes.jsonl").write_text("".join(json.dumps({"episode_id": f"e{i}"}) + "\n" for i in ids))
    read = lambda out: D.episode_sources(spark, str(tmp_path / "*" / "episodes.jsonl"), "episode_id string", "episode_id", out)
    assert [(r["source"], r["line"], r["episode_id"]) for r in read(str(tmp_path / "out" / "episodes.jsonl")).orderBy("source", "line").collect()] == [("a", 1, "e1"), ("a", 2, "e2"), ("b", 1, "e3")]
    with pytest.raises(Exception, match="repeated"):
        read(None).collect()
    episodes = spark.createDataFrame([("e1",), ("e2",)], "episode_id string")
    folder = str(tmp_path / "set")
    assert D.write_episodes(episodes, folder, "episode_id") == 2 and json.loads((tmp_path / "set" / "manifest.json").read_text()) == {"episodes": 2}
    with pytest.raises(Exception):
        D.write_episodes(episodes, folder, "episode_id")
    assert D.write_episodes(episodes.limit(1), folder, "episode_id", overwrite=True) == 1


def test_training_sets(spark, tmp_path):
    samples = spark.createDataFrame([(1, "Ann", 0, "user", "hi", None), (1, "Ann", 1, "assistant", "yes", True), (2, "B/b", 0, "user", "x", None)], "id int, target string, turn int, role string, content string, loss boolean")
    coverage = spark.createDataFrame([(4, 3, [2])], "total int, covered int, missing array<int>")
    folder = str(tmp_path / "sft")
    D.write_role_samples(samples, coverage, folder, ["id"])
    assert json.loads((tmp_path / "sft" / "manifest.json").read_text()) == {"samples": 2, "chunks": 4, "covered": 3, "missing": [2]}
    D.write_role_samples(samples.filter("id = 1"), coverage, folder, ["id"], overwrite=True)
    assert [p.name for p in (tmp_path / "sft" / "by_character").glob("character=*")] == ["character=Ann"]
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    assert D.write_reward_set(rows, rows, rows.limit(0), str(tmp_path / "eval")) == {"evaluation": 2, "mapping": 2, "unmatched": 0}
    D.backup(spark, str(tmp_path / "eval" / "statistics.json"), str(tmp_path / "kept.json"))
    with pytest.raises(FileExistsError):
        D.backup(spark, str(tmp_path / "eval" / "statistics.json"), str(tmp_path / "kept.json"))


def test_small_operators(spark):
    assert [r["sentence"] for r in D.ocr_sentences(spark.createDataFrame([("走吧；好。 ",), (" ",), (None,)], "text string"), "text").collect()] == ["走吧；", "好。"]
    units = spark.createDataFrame([(i,) for i in range(9)], "i int")
    assert D.first_units(units, ["i"], True).count() == 5 and D.first_units(units, ["i"], False).count() == 9
    pages = spark.createDataFrame([("a", "<p><img src='1'></p>"), ("a", "<p>x</p>"), ("b", "<p>" + "word " * 100 + "</p><img>"), ("c", "<p>x</p>")], "book string, html string")
    assert {r["book"]: r["picture_book"] for r in D.book_kind(pages, ["book"]).collect()} == {"a": True, "b": False, "c": False}
    times = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:59:00"), (3, None)], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [r["id"] for r in D.expired(times, "at", F.lit("2025-01-01 01:00:01").cast("timestamp"), 3600).collect()] == [1]
