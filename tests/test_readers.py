import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inkloom.functions import similarity as M
from inkloom.operators import records as K
from inkloom.sources import files, sinks
from inkloom.streaming import carry


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "chunks": [{"text": "x"}, {"text": "y"}]\n}')
    doc = files.read_json(spark, str(tmp_path / "a.json"), "chunks array<struct<text: string>>")
    assert [(r["chunk_name"], r["chunk"]["text"]) for r in files.chunk_rows(doc).collect()] == [("chunk-000000", "x"), ("chunk-000001", "y")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert {r["a"] for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()} == {1, 2}
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()


def test_profiles(spark, tmp_path):
    (tmp_path / "01 Book").mkdir()
    (tmp_path / "Book").mkdir()
    (tmp_path / "Book" / "Ann.txt").write_text("﻿ kind \n")
    assert files.profile_folder(spark, str(tmp_path), "02 Book", "x") == str(tmp_path / "Book")
    assert files.profile_folder(spark, str(tmp_path), "01 Book", "x") == str(tmp_path / "01 Book")
    assert files.profile_folder(spark, str(tmp_path), "none", "") is None
    assert [tuple(r) for r in files.read_profiles(spark, str(tmp_path / "Book")).collect()] == [("Ann", "kind")]
    assert files.read_profiles(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "Book" / "Bob.txt").write_text(" \n")
    with pytest.raises(Exception, match="empty profile"):
        files.read_profiles(spark, str(tmp_path / "Book")).collect()


def test_resources_in_order(spark):
    rows = [("b", "text", 2), ("a", "TEXT", 1)]
    schema = "path string, resource_type string, narrative_order int"
    assert [r["path"] for r in files.in_narrative_order(spark.createDataFrame(rows, schema)).collect()] == ["a", "b"]
    for bad in ([("c", "image", 1)], [("c", "text", 1), ("d", "text", 1)]):
        with pytest.raises(Exception):
            files.in_narrative_order(spark.createDataFrame(bad, schema)).collect()


def test_results_and_issues(spark, tmp_path):
    for i in range(2):
        sinks.append_results(spark.createDataFrame([(i,)], "unit int"), str(tmp_path / "r"))
    assert {r["unit"] for r in files.read_jsonl(spark, str(tmp_path / "r"), "unit int").collect()} == {0, 1}
    row = sinks.issues(spark.createDataFrame([(3, "x")], "line int, what string"), "bad", F.col("what"), "line").first()
    assert (row["code"], row["message"], json.loads(row["context"])) == ("bad", "x", {"line": 3})


def test_next_jobs(spark):
    jobs = spark.createDataFrame([(i,) for i in range(8)], "i int")
    done = spark.createDataFrame([(3, "ok"), (4, None)], "i int, result string")
    assert [r["i"] for r in K.next_jobs(jobs, done, "i", "result", 2, 3).orderBy("i").collect()] == [2, 4, 5]


def test_streams_of_results(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([(1, at, "a"), (1, at + dt.timedelta(minutes=1), "a"), (2, at + dt.timedelta(minutes=2), "a"), (3, at + dt.timedelta(hours=2), "b")], "unit int, at timestamp, kind string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    carry.run_available(carry.latest_results(stream, ["unit"], "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert sorted(r["unit"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2, 3]
    query = carry.activity(stream, "at", "kind", "10 minutes", "5 minutes").writeStream.format("memory").queryName("active").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["kind"], r["n"]) for r in spark.table("active").collect()) == [("a", 3), ("b", 1)]


def brute_edit(needle, text):
    """The least edit distance of ``needle`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(needle, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.mark.parametrize("needle, text", [("abcdef", "xxabcxdefyy"), ("hello world", "say helo wurld now"), ("走吧我们回家", "他说走吧咱们回家了"), ("abc", "abc"), ("night", "thelightofnigth")])
def test_best_edit(needle, text):
    found = M.best_edit(needle, text, 0.0)
    similarity, start, end = found
    assert similarity == pytest.approx(1 - brute_edit(needle, text) / max(len(needle), end - start))
    assert brute_edit(needle, text[start:end]) == brute_edit(needle, text)
    assert M.best_edit("", "x") is None and M.best_edit("x", "") is None and M.best_edit("abcdef", "zzzzzz") is None
