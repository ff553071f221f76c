"""Rebuilding scenes from boundaries that were found chunk by chunk."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class BoundaryError(ValueError):
    """A boundary that isn't in its text, or boundaries in an impossible order."""


def _place(text: str, mark: str, start: int) -> int:
    at = text.find(mark, start)
    if at < 0:
        raise BoundaryError(f"{mark!r} isn't in the text from {start} on")
    return at


def spans_of(text: str, marks: Sequence[tuple[str | None, str | None]], going_on: bool) -> list[tuple[int, int, bool]]:
    """The (start, end, closed) of each scene's part of one text, each after the one before.

    ``going_on``: the first mark continues a scene, so it begins with the text
    and its start doesn't matter.  Without marks the whole text is one open part.
    """
    out: list[tuple[int, int, bool]] = []
    cursor = 0
    for k, (start, end) in enumerate(marks):
        if out and not out[-1][2]:
            raise BoundaryError("an open scene comes before other marks")
        if going_on and k == 0:
            start = None
        begin = cursor if start is None else _place(text, start, cursor)
        cursor = len(text) if end is None else _place(text, end, begin) + len(end)
        out.append((begin, cursor, end is not None))
    # What follows a scene that was only continued and closed is the start of another.
    if not out or (going_on and len(out) == 1 and out[0][2] and cursor < len(text)):
        out.append((cursor, len(text), False))
    return out


def rebuild(chunks: Sequence[tuple[int, str, str]], boundaries: Sequence[Sequence[tuple[str | None, str | None]]]) -> list[list[tuple[int, int, int]]]:
    """Scenes as lists of (position, start, end) from (position, text, section) and each chunk's (start, end) marks.

    Scenes never cross a section, so each run of chunks of one section is
    folded by itself: a part that isn't closed takes in the first part of the
    next chunk, and the section's end closes it.
    """
    done: list[list[tuple[int, int, int]]] = []
    for _, run in itertools.groupby(zip(chunks, boundaries), key=lambda x: x[0][2]):
        going_on = False
        for (position, text, _), marks in run:
            for k, (start, end, closed) in enumerate(spans_of(text, marks, going_on)):
                if k == 0 and going_on:
                    done[-1].append((position, start, end))
                else:
                    done.append([(position, start, end)])
                last = closed
            going_on = not last
    return done


Mark = tuple[str | None, str | None]


def mend(marks: Sequence[Sequence[Mark]], truncated: Sequence[bool]) -> tuple[list[list[Mark]], list[bool], list[tuple[int, str]]]:
    """Marks and states with contradictions mended, and notes of (chunk, what).

    The state says whether a chunk's last scene goes on: a truncated chunk's
    last end doesn't count; a finished chunk without a last end stays open.  A
    scene without a start that follows a closed one in its chunk extends that
    one; at the head of a chunk it opens the last scene before again.
    """
    notes: list[tuple[int, str]] = []
    mended: list[list[Mark]] = []
    states = list(truncated)
    for i, given in enumerate(marks):
        own: list[Mark] = []
        for k, (start, end) in enumerate(given):
            if k + 1 == len(given):
                if states[i] and end is not None:
                    notes.append((i, "the end of a truncated chunk doesn't count"))
                    end = None
                elif not states[i] and end is None:
                    notes.append((i, "finished, but the last scene stays open"))
            if own and start is None and own[-1][1] is not None:
                notes.append((i, "joined to the scene before"))
                own[-1] = (own[-1][0], end)
            else:
                own.append((start, end))
        mended.append(own)
    last = None
    for i, own in enumerate(mended):
        if own and own[0][0] is None and last is not None and mended[last][-1][1] is not None:
            notes.append((i, "the last scene before goes on"))
            mended[last][-1] = (mended[last][-1][0], None)
            states[last] = True
        last = i if own else last
    return mended, states, notes


def recover(chunks: Sequence[tuple[int, str, str]], boundaries: Sequence[Sequence[Mark]], truncated: Sequence[bool], incomplete: bool = False) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, str]]]:
    """Like ``rebuild``, from ``mend``ed marks; also notes of (position, what).

    An open scene takes whole chunks without marks and goes on over sections;
    the next mark closes it, whatever its start.  Marks that aren't in their
    text, and a scene that begins nowhere, raise; a scene that is still open at
    the end raises unless ``incomplete``, which drops it.
    """
    marks, states, notes = mend(boundaries, truncated)
    notes = [(chunks[i][0], what) for i, what in notes]
    done: list[list[tuple[int, int, int]]] = []
    going: list[tuple[int, int, int]] | None = None
    began = None
    for (position, text, section), own, state in zip(chunks, marks, states):
        cursor, rest = 0, list(own)
        if going is not None:
            if section != began:
                notes.append((position, "the section changes under an open scene"))
            start, end = rest.pop(0) if rest else (None, None)
            if start is not None:
                notes.append((position, "the start of a scene that goes on doesn't count"))
            if end is None:
                if rest:
                    raise BoundaryError(f"chunk {position}: an open scene comes before other marks")
                going.append((position, 0, len(text)))
                continue
            cursor = _place(text, end, 0) + len(end)
            done.append([*going, (position, 0, cursor)])
            going = None
        elif not rest and state:
            raise BoundaryError(f"chunk {position}: truncated, and there is no scene to go on")
        for k, (start, end) in enumerate(rest):
            if start is None:
                raise BoundaryError(f"chunk {position}: a scene begins nowhere")
            if end is None and k + 1 < len(rest):
                raise BoundaryError(f"chunk {position}: an open scene comes before other marks")
            begin = _place(text, start, cursor)
            cursor = len(text) if end is None else _place(text, end, begin) + len(end)
            if not text[begin:cursor].strip():
                raise BoundaryError(f"chunk {position}: an empty scene")
            if end is None:
                going, began = [(position, begin, cursor)], section
            else:
                done.append([(position, begin, cursor)])
    if going is not None:
        if not incomplete:
            raise BoundaryError("the last scene is still open")
        notes.append((going[0][0], "an incomplete scene was dropped"))
    return done, notes


def rebuild_scenes(chunks: DataFrame, keys: Sequence[str], position: str, section: str, marks: str, truncated: str | None = None, incomplete: bool = True) -> DataFrame:
    """``keys, scene, piece, position, span_start, span_end, error`` per group of chunks with ``text`` and an array of (start, end) marks.

    With a column that says which chunks are ``truncated`` the scenes are
    recovered (``recover``), else rebuilt (``rebuild``).  A group with
    impossible marks gives one row with the error.  Scenes carry over chunks,
    so a group is one task's work.  Rebuilt scenes never cross a section, so
    there the runs of one section are the groups and scenes are numbered
    afterwards.
    """
    if truncated is None:
        runs = chunks.withColumn("_new", F.coalesce((~F.lag(section).over(W.partitionBy(*keys).orderBy(position)).eqNullSafe(F.col(section))).cast("int"), F.lit(1)))
        runs = runs.withColumn("_run", F.sum("_new").over(W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0))).drop("_new")
        found = _by_group(runs, [*keys, "_run"], position, section, marks, None, True)
        # Scenes of the runs before, and of an error none.
        before = found.groupBy(*keys, "_run").agg((F.coalesce(F.max("scene"), F.lit(-1)) + 1).alias("_scenes"), F.max("error").alias("_error"))
        first = before.withColumn("_before", F.coalesce(F.sum("_scenes").over(W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_failed", F.first("_error", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        joined = found.join(first.select(*keys, "_run", "_before", "_failed"), [*keys, "_run"])
        # A group with an error has only that row.
        kept = joined.filter(F.col("_failed").isNull() | (F.col("error") == F.col("_failed")))
        return kept.select(*keys, (F.col("scene") + F.col("_before")).cast("int").alias("scene"), "piece", "position", "span_start", "span_end", "error").dropDuplicates()
    return _by_group(chunks, keys, position, section, marks, truncated, incomplete)


def _by_group(chunks: DataFrame, keys: Sequence[str], position: str, section: str, marks: str, truncated: str | None, incomplete: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_position")
        head = [frame[k].iloc[0] for k in keys]
        rows = [(int(p), t or "", s) for p, t, s in zip(frame["_position"], frame["_text"], frame["_section"])]
        given = [[(m["start"], m["end"]) for m in (ms if ms is not None else [])] for ms in frame["_marks"]]
        try:
            found = rebuild(rows, given) if truncated is None else recover(rows, given, [bool(x) for x in frame["_truncated"]], incomplete)[0]
            out = [(*head, i, j, *piece, None) for i, scene in enumerate(found) for j, piece in enumerate(scene)]
        except BoundaryError as error:
            out = [(*head, None, None, None, None, None, str(error))]
        whole = {c: "Int64" for c in ("scene", "piece", "position", "span_start", "span_end")}
        return pd.DataFrame(out, columns=[*keys, "scene", "piece", "position", "span_start", "span_end", "error"]).astype(whole)

    slim = chunks.select(*keys, F.col(position).alias("_position"), F.col("text").alias("_text"), F.col(section).alias("_section"), F.col(marks).alias("_marks"), (F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False))).alias("_truncated"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", scene int, piece int, position int, span_start int, span_end int, error string"
    return slim.groupBy(*keys).applyInPandas(run, schema)
