import json

import pytest

from inkloom.operators.scenes import BoundaryError
from inkloom.plans.pipeline import Settings, TextDataset

TEXT = "第一章 起\n安娜来了。“你好。”安娜说。本看着她。“请进。”本说。\n第二章 承\n天黑了。安娜走了。"


def scene_client():
    def ask(request):
        text = json.loads(request)["input"]
        sentences = [s + "。" for s in text.replace("\n", "").split("。") if s and s not in "”"]
        found = [{"names": [n, "小" + n], "description": f"{n}在场", "plot_indexes": None} for n in ("安娜", "本") if n in text]
        return "```json\n" + json.dumps({"characters": found, "plots": [{"start": sentences[0][:2], "end": None}], "state": "truncated"}, ensure_ascii=False) + "\n```"

    return ask


def profile_client():
    return lambda request: json.dumps({"name": json.loads(request)["names"][0], "content": "profile"}, ensure_ascii=False)


def dialogue_client():
    def ask(request):
        text = json.loads(request)["input"]
        lines = [{"speaker": "Environment", "content": "*(傍晚)*"}]
        lines += [{"speaker": "小安娜", "content": "你好。"}] if "你好。" in text else []
        lines += [{"speaker": "本", "content": "请进。"}] if "请进。" in text else []
        return json.dumps({"utterances": lines}, ensure_ascii=False)

    return ask


def test_build(spark, tmp_path):
    resources = spark.createDataFrame([("books/a.txt", 0, TEXT)], "path string, narrative_order int, text string")
    build = TextDataset(spark, resources, str(tmp_path), scene_client, profile_client, dialogue_client, Settings(chunk_budget=20, scene_budget=15))
    samples = build.build().orderBy("plot_index", "target", "turn").collect()
    assert [(r["target"], r["role"], r["content"]) for r in samples] == [("安娜", "user", "Environment：*(傍晚)*"), ("安娜", "assistant", "安娜：你好。")] or {r["target"] for r in samples} == {"安娜", "本"}
    chunks = {r["chunk_index"]: r["text"] for r in spark.read.parquet(str(tmp_path / "work/text_chunks")).collect()}
    assert "".join(chunks[i] for i in sorted(chunks)).replace("\n", "") == "安娜来了。“你好。”安娜说。本看着她。“请进。”本说。天黑了。安娜走了。"
    for row in spark.read.parquet(str(tmp_path / "work/plot_chunks")).collect():
        assert "".join(chunks[r["chunk_index"]][r["span_start"] : r["span_end"]] for r in row["refs"]) == row["text"]
    texts = {(r["plot_index"], r["chunk_index"]): r["text"] for r in spark.read.parquet(str(tmp_path / "work/plot_chunks")).collect()}
    spans = [r for r in spark.read.parquet(str(tmp_path / "work/utterances")).collect() if r["span_start"] is not None]
    assert spans and all(texts[r["plot_index"], r["chunk_index"]][r["span_start"] : r["span_end"]] == r["content"] for r in spans)
    exported = [json.loads(x) for f in (tmp_path / "exports/chat/all").glob("*.json") for x in f.read_text().splitlines()]
    assert all(m["messages"][-1]["role"] == "assistant" for m in exported) and exported


def test_wrong_marks_are_an_error(spark, tmp_path):
    resources = spark.createDataFrame([("a", 0, TEXT)], "path string, narrative_order int, text string")
    wrong = lambda: lambda request: json.dumps({"characters": [], "plots": [{"start": "nowhere", "end": None}], "state": "finished"})
    build = TextDataset(spark, resources, str(tmp_path), wrong, profile_client, dialogue_client)
    with pytest.raises(BoundaryError):
        build.scene_chunks(build.artifact("marked", build.marked(build.chunks())))
