import json

from pyspark.sql import functions as F

from inkloom.plans import stages


def answering(reply):
    """A factory of clients that answer by the request's content; a plain function, so it works in any task."""
    return lambda: lambda request: json.dumps(reply(json.loads(request)), ensure_ascii=False)


def test_blocks_of_dialogue(spark):
    chunks = spark.createDataFrame([("f", 0, i, f"t{i} ") for i in range(6)], "file string, plot_index int, chunk_index int, text string")
    cast = spark.createDataFrame([("f", ["A", "a"])], "file string, names array<string>")
    make = answering(lambda r: {"utterances": [{"speaker": "A" if r["opening"] else "B", "content": r["input"]}]})
    got = stages.dialogue_blocks(chunks, cast, make).orderBy("block").collect()
    assert [(r["block"], r["told"]["utterances"][0]["speaker"], r["told"]["utterances"][0]["content"]) for r in got] == [(0, "A", "t0 t1 t2 t3 "), (1, "B", "t4 t5 ")]


def test_errors_are_fed_back(spark):
    scenes = spark.createDataFrame([(1, "text", ["A"])], "id int, input string, characters array<string>")
    make = answering(lambda r: {"plot": "p", "tasks": [{"name": "A", "values": ["x", "y"] if "errors" in r else ["x", "x"]}]})
    row = stages.extract_tasks(scenes, make).first()
    assert row["attempts"] == 2 and row["told"]["tasks"][0]["values"] == ["x", "y"]
    failed = stages.extract_tasks(scenes, answering(lambda r: {"tasks": [{"name": "A", "values": []}]})).first()
    assert failed["told"] is None and "empty or repeated" in failed["error"] and failed["attempts"] == 3


def test_states_are_carried_and_a_failure_stops_its_scene(spark):
    rows = [("f", 0, i, f"c{i}") for i in range(4)] + [("f", 1, 0, "ok"), ("f", 1, 1, "bad"), ("f", 1, 2, "never"), ("f", 2, 0, "ok"), ("f", 2, 2, "gap")]
    chunks = spark.createDataFrame(rows, "file string, plot_index int, chunk_index int, text string")

    def reply(r):
        inner = json.loads(r["request"]) if "request" in r else r
        if inner["input"] == "bad":
            return {"nodes": "none"}
        seen = sorted(n["name"] for n in inner["prenodes"])
        number = inner["input"][1:]
        return {"nodes": [{"name": f"n{number}.mood", "after": ",".join(seen)}, *([{"name": "A.location", "after": "mill"}] if number == "0" else [])]}

    got = {(r["plot_index"], r["chunk_index"]): r for r in stages.extract_states(chunks, answering(reply)).collect()}
    mood = lambda i: json.loads(got[0, i]["result"])["nodes"][0]["after"]
    assert [mood(i) for i in range(4)] == ["", "A.location,n0.mood", "A.location,n1.mood", "A.location,n2.mood"]
    assert got[1, 0]["error"] is None and got[1, 1]["attempts"] == 3 and got[1, 2]["error"] == "chunk 1 failed" and got[1, 2]["attempts"] == 0
    assert got[2, 2]["error"] == "chunk 1 is missing"


def test_picture_books(spark):
    batches = spark.createDataFrame([(0, 0, 1, ["p0", "p1"]), (1, 2, 2, ["p2"])], "batch int, first int, last int, pages array<string>")
    make = answering(lambda r: {"utterances": [{"page_index": 0 if len(r["pages"]) == 2 else 9, "speaker": "1", "content": "hi"}], "characters": [{"character_index": "1", "names": ["A"], "description": "d"}], "chapter_starts": [0], "plot": "x"})
    told = stages.read_pages(batches, make)
    assert [(r["batch"], r["problem"]) for r in stages.page_lines(told, "batch", "first", "last").orderBy("batch").collect()] == [(0, None), (1, "page outside")]
    seen = spark.createDataFrame([("b", str(i), [f"N{i % 2}"], "d" * 20) for i in range(5)], "book string, observation string, names array<string>, description string")
    cat = stages.catalogue(seen, "book", answering(lambda r: {"characters": [{"name": n, "aliases": [], "description": ""} for n in sorted({o["names"][0] for o in r["observations"]})]}))
    assert sorted(r["name"] for r in cat.collect()) == ["N0", "N1"]
    give = answering(lambda r: {"assignments": [{"observation": o["observation"], "name": o["names"][0] if o["observation"] != "4" else "nobody"} for o in r["observations"]]})
    got = stages.assign_observations(seen, cat, "book", give, 150)
    assert {r["observation"]: r["name"] for r in got.collect()} == {"0": "N0", "1": "N1", "2": "N0", "3": "N1", "4": None}
    chapters = spark.createDataFrame([(0, "p", ["A"], ["A: hi"])], "chapter int, plot string, characters array<string>, lines array<string>")
    assert stages.revise_lines(chapters, answering(lambda r: {"utterances": [{"speaker": "A", "content": r["lines"][0][3:]}]})).first()["told"]["utterances"][0]["content"] == "hi"
    lines = spark.createDataFrame([("b", "N0")], "book string, speaker string")
    profiles = stages.describe_characters(cat, lines, ["book"], answering(lambda r: {"name": r["name"], "content": "kind"}))
    assert [(r["name"], r["told"]["content"]) for r in profiles.select("name", "told").collect()] == [("N0", "kind")]
    assert profiles.filter(F.col("error").isNotNull()).count() == 0
