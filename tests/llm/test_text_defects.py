import pytest

from inkloom.llm import endings
from inkloom.llm.cutoff import CutOff, limits
from inkloom.llm.pairs import defects

SCHEMA = "candidate_id bigint, reference_response string, messages array<struct<role string, content string>>, defect string"
USER = "Hollis Grey: If the baker finds the ladder, we are finished before noon!"
WHOLE = ["The baker carried the ladder to the old mill. Nobody followed him there.", "Leave the mill. The old ladder is all that the baker asked of us.", "I never touched that ladder; ask the baker if you doubt me."]


def candidate(i, response, user=USER, system="You are Hollis Grey. Speak only as the baker of the mill."):
    return (i, response, [("system", system), ("user", user), ("assistant", response)], "clash")


@pytest.fixture(scope="module")
def found(spark):
    cases = {
        1: None, 2: "", 3: " ​　", 4: "(none)", 5: "……", 6: "*()*", 7: "N/A",
        10: "I'm sorry, but I can't continue this role-play.", 11: "很遗憾，该请求可能违反内容规范，我不能生成这句台词。", 12: "Leider kann ich bei dieser Szene nicht helfen, bitte stell eine andere Anfrage.", 13: "Lo siento, no puedo continuar con este juego de rol.", 14: "申し訳ありませんが、このロールプレイを続けることはできません。",
        20: "If the baker finds the ladder, we are finished before noon!", 21: "IF THE BAKER FINDS THE LADDER, WE ARE FINISHED BEFORE NOON!", 22: "the baker finds the ladder, we are finished before noon! Hm.",
        30: "Der Bäcker und die Leiter sind nicht bei uns, aber ich habe dich gesehen.", 31: "面包师把梯子带到了旧磨坊，没有人跟着他。",
        40: "The baker carried the ladder to the,", 41: "*(The baker carried the ladder", 42: "“The baker carried the ladder to the old mill.",
        50: "I cannot help you with the ladder, not while the baker watches.", 51: "No.", 52: "Then go to the mill and say that the baker sold it—", 53: "Go on…", 54: WHOLE[0], 55: "*(The baker nodded.)* Leave the mill.",
    }
    rows = [candidate(i, r) for i, r in cases.items()] + [candidate(1000 + i, WHOLE[i % 3]) for i in range(60)]
    rows += [candidate(54, WHOLE[0]), (60, "Yes, of course he did.", None, "clash"), (61, None, [], "clash")]
    out = defects(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len({r["candidate_id"] for r in out})
    return {r["candidate_id"]: r["defect"] for r in out}


def test_types(found):
    want = dict.fromkeys([1, 2, 3, 4, 5, 6, 7, 61], "empty") | dict.fromkeys([10, 11, 12, 13, 14], "refusal") | dict.fromkeys([20, 21, 22], "copy") | dict.fromkeys([30, 31], "language") | dict.fromkeys([40, 41, 42], "truncated")
    assert found == want


def test_refusals_without_other_stems(spark):
    from pyspark.sql import functions as F
    from inkloom.llm.pairs import _refused

    rows = spark.createDataFrame([("i'm sorry, but that's not something i can help with.",), ("lo siento, va contra las políticas de uso.",), ("the baker carried the ladder.",)], "low string")
    assert [r[0] for r in rows.select(_refused(F.col("low"))).collect()] == [True, True, False]


def test_no_rows(spark):
    assert defects(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ending_model_tells_cuts_from_missing_stops():
    texts = [f"The {a} {b} carried the {c} to the old mill. Nobody in {d} followed the {b} there." for a in ("old", "young", "tall") for b in ("baker", "tailor", "weaver") for c in ("ladder", "rope", "coin") for d in ("Oldwater", "Pellgate")]
    model = endings.train(texts * 3)
    whole = model.score(["The old baker carried the coin to the old mill", "Nobody in Pellgate followed the weaver there"])
    cut = model.score(["The old baker carried the", "Nobody in Pellgate fol", "The young tailor carr", "The tall weaver carried the rope to the"])
    assert (whole > 0).all() and (cut < 0).all()
    assert len(endings.train([]).score(["x"])) == 1


def outputs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "output_id bigint, source string, content string, reason string, kind string")


def test_cut_outputs(spark):
    sound = "The smuggler of Greycombe emptied every river that winter. No one followed the tailor home."
    rows = [
        (1, "m", '{"a": [1, 2', "stop"), (2, "m", '{"a": "x', "stop"), (3, "m", '{"a": [1, 2],}', "length"), (4, "m", '```json\n{"a": 1}\n', "stop"), (5, "m", '```json\n{"a": 1}\n```', "stop"),
        (6, "m", None, "length"), (7, "m", "  ", "length"), (8, "m", "He said “leave the gate.", "stop"), (9, "m", sound, "length"), (10, "m", "It ended well. The smuggler of Greycombe emptied every,", "stop"), (11, "m", "The tailor went home.\n\n<end>", "stop"), (12, None, '{"b": {', None), (12, None, '{"b": {', None),
        (13, "m", '{"a": "he said \\"go\\" [', "stop"), (14, "m", "name: A\nhome: B\nstatus: complete", "stop"), (15, "m", "name: C\nhome: D\nstatus: complete", "stop"), (16, "m", "name: E\nho", "stop"),
    ]
    rows += [(100 + i, "m", sound, "stop") for i in range(40)]
    got = sorted(r["output_id"] for r in CutOff(outputs(spark, rows)).found.collect())
    assert got == [1, 2, 4, 8, 10, 12, 13, 16]


def test_limits_stand_out(spark):
    lengths = [("a", "chars", 100 + i) for i in range(400)] + [("a", "chars", 300)] * 40 + [("b", "chars", 50 + i % 200) for i in range(600)] + [(None, "chars", 7)]
    found = limits(spark.createDataFrame(lengths, "source string, unit string, length int")).collect()
    assert {(r["source"], r["length"]) for r in found} == {("a", 300)}


def test_only_the_limit_decides(spark):
    """A last sentence that could be whole is cut where the hazard of its length is far above its neighbours', and not elsewhere."""
    texts = [f"The {a} {b} of Greycombe emptied every {c} that winter. No one followed the {b} home{d}." for a in ("old", "young", "tall", "brave") for b in ("tailor", "weaver", "baker") for c in ("river", "cellar", "barrel", "wardrobe") for d in ("", " to Dunmarrow", " to Wex")]
    ending = "No one followed the tailor home"
    pad = lambda n: ("The tailor of Greycombe emptied every river. " * 9)[: n - len(ending) - 2].rstrip() + ". "
    fit = lambda n: (pad(n) + ending).rjust(n, "A")[-n:]
    rows = [(i, "m", t, "stop") for i, t in enumerate(texts)] + [(1000 + i, "m", fit(300), "stop") for i in range(40)] + [(2000, "m", fit(290), "stop")]
    rows += [(3000 + i, "m", (texts[i] + " " + texts[i + 1])[: 210 + i % 37] + ".", "stop") for i in range(100)]
    got = {r["output_id"]: (r["by"], r["needed"]) for r in CutOff(outputs(spark, rows)).found.collect()}
    assert 2000 not in got and all(got[1000 + i] == ("limit", True) for i in range(40))


def test_cards_of_two_layouts(spark):
    rows = [(i, "m", f"name: A{i}\nhome: B\nstatus: complete", "stop") for i in range(50)] + [(100 + i, "m", f"item: C{i}\nprice: {i}", "stop") for i in range(5)] + [(200, "m", "name: Z\nhome: B\nstatus: comp", "stop"), (201, "m", "name: Z\nhome: B", "stop")]
    assert {r["output_id"] for r in CutOff(outputs(spark, rows)).found.collect()} == {200, 201}


def test_no_outputs(spark):
    assert CutOff(outputs(spark, [])).found.collect() == []
