"""Finding extracted lines in their source, in order, with a cursor.

The cursor makes these operators sequential inside a group, so a group (a
chunk, a record) is one task's work and groups run in parallel.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.similarity import best_window, normalize_with_positions, ratio
from inkloom.functions.text import NARRATOR


def align_lines(text: str, lines: Sequence[tuple[str, str]], least: float = 90.0, fuzzy_chars: int = 6) -> list[tuple[int, int] | None]:
    """The span of each (speaker, content), each at or after the end of the last one found.

    Exact places come first; a line of enough visible characters may be found
    by likeness.  Narration has no span; a line that isn't found has none and
    leaves the cursor.
    """
    cursor, out = 0, []
    for speaker, content in lines:
        span = None
        if speaker != NARRATOR and content:
            at = text.find(content, cursor)
            if at >= 0:
                span = (at, at + len(content))
            elif sum(not c.isspace() for c in content) >= fuzzy_chars and cursor < len(text):
                found = best_window(content, text[cursor:], least)
                if found and found[2] > found[1]:
                    span = (cursor + found[1], cursor + found[2])
        if span:
            cursor = span[1]
        out.append(span)
    return out


def _by_text(lines: DataFrame, sources: DataFrame, keys: Sequence[str], order: Sequence[str], line_id: str) -> DataFrame:
    """One row per source with its lines in order, so that a text travels once; lines without a source have a null text."""
    item = F.struct(*order, F.col(line_id).alias("_id"), F.col("speaker").alias("_speaker"), F.col("content").alias("_content"))
    gathered = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_lines"))
    return gathered.join(sources, list(keys), "left").select("_lines", F.col("text").alias("_text"))


def forward_align(lines: DataFrame, sources: DataFrame, keys: Sequence[str], order: Sequence[str], line_id: str, least: float = 90.0) -> DataFrame:
    """``line_id, span_start, span_end`` of every line; nulls where it isn't found."""

    def run(frames):
        for frame in frames:
            out = []
            for items, text in zip(frame["_lines"], frame["_text"]):
                spans = align_lines(text or "", [(x["_speaker"], x["_content"]) for x in items], least)
                out += [(x["_id"], *(s or (None, None))) for x, s in zip(items, spans)]
            yield pd.DataFrame(out, columns=[line_id, "span_start", "span_end"]).astype({"span_start": "Int64", "span_end": "Int64"})

    return _by_text(lines, sources, keys, order, line_id).mapInPandas(run, f"{line_id} bigint, span_start bigint, span_end bigint")


def place_units(text: str, units: Sequence[tuple[str, str]], strong: int = 4) -> list[tuple[int | None, str | None]]:
    """Place and issue of each (speaker, content): first the long ones forward, then the short ones between their neighbours.

    Comparing is by normal form; a unit without letters is compared as it is.
    """
    norm, places = normalize_with_positions(text)
    forms = [normalize_with_positions(c or "")[0] for _, c in units]
    found: list[int | None] = [None] * len(units)
    cursor = 0
    for i, f in enumerate(forms):
        if len(f) >= strong and units[i][0] != NARRATOR:
            at = norm.find(f, cursor)
            if at >= 0:
                found[i], cursor = at, at + len(f)
    issues: list[str | None] = [None] * len(units)
    # The nearest place behind each unit; those of the first pass only grow.
    after, ahead = [len(norm)] * len(units), len(norm)
    for i in range(len(units) - 1, -1, -1):
        after[i] = ahead
        ahead = found[i] if found[i] is not None else ahead
    low = 0
    for i, f in enumerate(forms):
        if found[i] is not None:
            low = max(low, found[i] + len(f))
            continue
        high = after[i]
        if f:
            at = norm.find(f, low, high)
            if at >= 0:
                found[i], low = at, at + len(f)
            else:
                issues[i] = "not found"
        else:
            raw = (units[i][1] or "").strip()
            begin = places[low] if low < len(places) else len(text)
            end = places[high] if high < len(places) else len(text)
            at = text.find(raw, begin, end) if raw else -1
            issues[i] = None if at >= 0 else "no letters"
    return [(places[p] if p is not None and p < len(places) else None, issue) for p, issue in zip(found, issues)]


def bounded_align(lines: DataFrame, sources: DataFrame, keys: Sequence[str], order: Sequence[str], line_id: str) -> DataFrame:
    """``line_id, position, issue``: the two passes of ``place_units`` for each source."""

    def run(frames):
        for frame in frames:
            out = []
            for items, text in zip(frame["_lines"], frame["_text"]):
                out += [(x["_id"], *p) for x, p in zip(items, place_units(text or "", [(x["_speaker"], x["_content"]) for x in items]))]
            yield pd.DataFrame(out, columns=[line_id, "position", "issue"]).astype({"position": "Int64"})

    return _by_text(lines, sources, keys, order, line_id).mapInPandas(run, f"{line_id} bigint, position bigint, issue string")


# Where a located line may begin and end.
CLAUSE_MARKS = "\n。！？!?，,；;：:.…「」"
_CLAUSE = re.compile(f"[{CLAUSE_MARKS}]")


def widen_to_marks(text: str, start: int, end: int, floor: int = 0) -> tuple[int, int]:
    """Widen a span of at least one character to the marks around it, never left of ``floor``.

    A side that already is a mark stays.  The mark behind the span is taken
    in unless it is a line end.
    """
    if text[start] not in CLAUSE_MARKS:
        start = max(floor, *(text.rfind(mark, floor, start) + 1 for mark in CLAUSE_MARKS))
    if text[end - 1] not in CLAUSE_MARKS:
        mark = _CLAUSE.search(text, end)
        end = len(text) if mark is None else mark.start() + (mark.group() != "\n")
    return start, end


def locate_line(text: str, content: str, cursor: int, least: float = 80.0) -> tuple[float, int, int] | None:
    """Score and widened span of a line at or after the cursor: the exact place, else the window most like it; null below ``least``.

    Of a line that is written as narration the inside is looked for.
    """
    sought = content[2:-2] if content.startswith("*(") and content.endswith(")*") else content
    if not sought or cursor >= len(text):
        return None
    at = text.find(sought, cursor)
    if at >= 0:
        return (100.0, *widen_to_marks(text, at, at + len(sought), cursor))
    near = best_window(sought, text[cursor:], least)
    if near is None or near[1] >= near[2]:
        return None
    return (near[0], *widen_to_marks(text, cursor + near[1], cursor + near[2], cursor))


def locate_lines(text: str, lines: Sequence[tuple[str | None, str | None]], least: float = 80.0) -> list[tuple[float, int, int] | None]:
    """``locate_line`` of each (speaker, content), each after the one found before; the narrator's lines and those not found have no place and leave the cursor."""
    out, cursor = [], 0
    for speaker, content in lines:
        hit = locate_line(text, content, cursor, least) if content and speaker != NARRATOR else None
        cursor = hit[2] if hit else cursor
        out.append(hit)
    return out


def expanding_locate(lines: DataFrame, sources: DataFrame, keys: Sequence[str], order: Sequence[str], line_id: str, least: float = 80.0) -> DataFrame:
    """``line_id, exact, span_start, span_end, source``: the clauses of the text in which each line lies; nulls where it isn't found."""

    def run(frames):
        for frame in frames:
            out = []
            for items, text in zip(frame["_lines"], frame["_text"]):
                text = text or ""
                found = locate_lines(text, [(x["_speaker"], x["_content"]) for x in items], least)
                out += [(x["_id"], hit[0] >= 100.0, hit[1], hit[2], text[hit[1] : hit[2]]) if hit else (x["_id"], None, None, None, None) for x, hit in zip(items, found)]
            yield pd.DataFrame(out, columns=[line_id, "exact", "span_start", "span_end", "source"]).astype({"exact": "boolean", "span_start": "Int64", "span_end": "Int64"})

    return _by_text(lines, sources, keys, order, line_id).mapInPandas(run, f"{line_id} bigint, exact boolean, span_start bigint, span_end bigint, source string")


def ordered_score(anchors: Sequence[tuple[str, bool]], text: str) -> tuple[int, float, int]:
    """Score, coverage and number of the (anchor, of the target) found one after the other in ``text``.

    The score is the found anchors' length and ten for each of the target's;
    the coverage is the share of all anchors' length.
    """
    cursor, length, bonus, found = 0, 0, 0, 0
    for anchor, target in anchors:
        at = text.find(anchor, cursor)
        if at >= 0:
            cursor, length, bonus, found = at + len(anchor), length + len(anchor), bonus + 10 * target, found + 1
    total = sum(len(a) for a, _ in anchors)
    return length + bonus, length / total if total else 0.0, found


#: Code points of an anchor's beginning by which scenes are looked up: the longest that fits.
SEEDS = (4, 8)


def score_scenes(anchors: DataFrame, scenes: DataFrame, scope: Sequence[str], record: str, order: Sequence[str], scene: str, least_anchors: int = 2) -> DataFrame:
    """``scope, record, scene, score, coverage, anchors`` of the scenes that may hold at least so many of a record's anchors.

    ``anchors`` has ``anchor`` (at least four code points) and ``target``,
    ``scenes`` has ``text``, both in normal form.  Scenes are looked up by the
    anchors' beginnings, so a record meets only scenes that may hold some of
    its anchors, not all of its scope.
    """
    size = F.when(F.length("anchor") >= SEEDS[1], SEEDS[1]).otherwise(SEEDS[0])
    seeds = anchors.groupBy(*scope, record, F.substring(F.col("anchor"), F.lit(1), size).alias("_seed")).agg(F.count("*").alias("_times"))
    wanted = seeds.select(*scope, "_seed").distinct()

    def grams(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - k + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(k)))

    held = scenes.select(*scope, scene, F.explode(F.array_distinct(F.concat(*map(grams, SEEDS)))).alias("_seed")).join(wanted, [*scope, "_seed"], "left_semi").distinct()
    met = seeds.join(held, [*scope, "_seed"]).groupBy(*scope, record, scene).agg(F.sum("_times").alias("_n")).filter(F.col("_n") >= least_anchors).drop("_n")
    item = F.struct(*order, F.col("anchor").alias("_anchor"), F.col("target").alias("_target"))
    listed = anchors.groupBy(*scope, record).agg(F.array_sort(F.collect_list(item)).alias("_listed"))
    asked = met.join(listed, [*scope, record]).join(scenes.select(*scope, scene, F.col("text").alias("_text")), [*scope, scene])

    def run(frames):
        for frame in frames:
            scores = [ordered_score([(x["_anchor"], bool(x["_target"])) for x in items], text or "") for items, text in zip(frame["_listed"], frame["_text"])]
            out = frame[[*scope, record, scene]].copy()
            for i, name in enumerate(("score", "coverage", "anchors")):
                out[name] = [x[i] for x in scores]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return asked.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*scope, record, scene]) + ", score bigint, coverage double, anchors bigint")


def match_turns(left: Sequence[tuple[str, str]], right: Sequence[tuple[str, Sequence[str]]]) -> list[int | None]:
    """For each (normal text, name) on the left the next of (normal text, names) on the right with the same text and a fitting name."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, (text, _) in enumerate(right):
        places[text].append(j)
    cursor, out = 0, []
    for text, name in left:
        same = places.get(text, [])
        hit = next((j for j in same[bisect_left(same, cursor) :] if name in right[j][1] or not name), None)
        if hit is not None:
            cursor = hit + 1
        out.append(hit)
    return out


def match_ocr(seen: Sequence[str], read: Sequence[str], least: float = 70.0) -> list[int | None]:
    """For each seen line the read line that replaces it: pairs by likeness, best first, each line once."""
    scored = sorted(((-ratio(a, b), i, j) for i, a in enumerate(seen) for j, b in enumerate(read) if a and b and ratio(a, b) >= least))
    out: list[int | None] = [None] * len(seen)
    used: set[int] = set()
    for _, i, j in scored:
        if out[i] is None and j not in used:
            out[i] = j
            used.add(j)
    return out


def ocr_corrections(seen: DataFrame, read: DataFrame, keys: Sequence[str], seen_id: str, read_id: str, least: float = 70.0) -> DataFrame:
    """``seen_id, read_id``: on each page, which read line corrects a seen one; pages without both sides give no row."""
    a = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seen_id).alias("_id"), F.col("form").alias("_form")))).alias("_a"))
    b = read.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(read_id).alias("_id"), F.col("form").alias("_form")))).alias("_b"))

    def run(frames):
        for frame in frames:
            out = []
            for x, y in zip(frame["_a"], frame["_b"]):
                out += [(x[i]["_id"], y[j]["_id"]) for i, j in enumerate(match_ocr([v["_form"] or "" for v in x], [v["_form"] or "" for v in y], least)) if j is not None]
            yield pd.DataFrame(out, columns=[seen_id, read_id])

    return a.join(b, list(keys)).select("_a", "_b").mapInPandas(run, f"{seen_id} bigint, {read_id} bigint")


def turn_matches(turns: DataFrame, lines: DataFrame, keys: Sequence[str], turn_order: Sequence[str], turn_id: str, line_order: Sequence[str], line_id: str) -> DataFrame:
    """``turn_id, line_id``: each turn's next line of the same ``form`` by a fitting speaker, always forward; turns without one give no row.

    ``turns`` and ``lines`` have ``form`` and ``name``.
    """
    pack = lambda df, order, key: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("_id"), F.col("form").alias("_form"), F.col("name").alias("_name")))).alias(f"_{key}"))
    both = pack(turns, turn_order, turn_id).join(pack(lines, line_order, line_id), list(keys)).select(F.col(f"_{turn_id}").alias("_a"), F.col(f"_{line_id}").alias("_b"))

    def run(frames):
        for frame in frames:
            out = []
            for x, y in zip(frame["_a"], frame["_b"]):
                found = match_turns([(v["_form"], v["_name"]) for v in x], [(v["_form"], [v["_name"]]) for v in y])
                out += [(v["_id"], y[j]["_id"]) for v, j in zip(x, found) if j is not None]
            yield pd.DataFrame(out, columns=[turn_id, line_id])

    return both.mapInPandas(run, f"{turn_id} bigint, {line_id} bigint")
