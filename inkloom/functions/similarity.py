"""Similarity of strings: indel ratio, best window, semi-global edit distance, and a normal form with positions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths, 0 to 100; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def best_window(needle: str, text: str, least: float = 0.0) -> tuple[float, int, int] | None:
    """Score, start and end of the window of ``text`` most like ``needle``; null below ``least``.

    Windows are as long as the needle, or shorter at the text's ends; of equal
    scores the first counts.  How many characters a window has in common with
    the needle in any order bounds its score, so few windows are compared.  A
    text shorter than the needle is compared whole.
    """
    if not needle or not text:
        return None
    m, n = len(needle), len(text)
    if n <= m:
        score = ratio(needle, text)
        return (score, 0, n) if score >= least else None
    x, y = _codes(needle), _codes(text)
    alphabet, need = np.unique(x, return_counts=True)
    at = np.searchsorted(alphabet, y)
    at[at == len(alphabet)] = 0
    known = alphabet[at] == y
    sums = np.zeros((len(alphabet), n + 1), np.int32)
    sums[at[known], np.flatnonzero(known) + 1] = 1
    np.cumsum(sums, 1, out=sums)
    start = np.concatenate([np.zeros(m - 1, np.int64), np.arange(n - m + 1), np.arange(n - m + 1, n)])
    end = np.concatenate([np.arange(1, m), np.arange(m, n + 1), np.full(m - 1, n)])
    bound = 200.0 * np.minimum(sums[:, end] - sums[:, start], need[:, None]).sum(0) / (m + end - start)
    best: tuple[float, int, int] | None = None
    for i in np.lexsort((end, start, -bound)).tolist():
        if bound[i] < least or (best and bound[i] < best[0]):
            break
        score = ratio(needle, text[start[i] : end[i]])
        if score >= least and (best is None or (-score, int(start[i]), int(end[i])) < (-best[0], best[1], best[2])):
            best = (score, int(start[i]), int(end[i]))
    return best


def best_edit(needle: str, text: str, least: float = 0.8) -> tuple[float, int, int] | None:
    """Similarity, start and end of the part of ``text`` at the least edit distance; null if 1 - distance/longer is below ``least``.

    Of equal distances, matches go before deletions, insertions and
    substitutions, and the earliest end counts.
    """
    found = text.find(needle)
    if needle and found >= 0:
        return 1.0, found, found + len(needle)
    if not needle or not text:
        return None
    cost, begin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, c in enumerate(needle, 1):
        new, from_ = [i], [begin[0]]
        for j, d in enumerate(text, 1):
            if c == d and cost[j - 1] <= min(cost[j], new[j - 1]) + 1:
                new.append(cost[j - 1])
                from_.append(begin[j - 1])
                continue
            options = [(cost[j] + 1, begin[j]), (new[j - 1] + 1, from_[j - 1]), (cost[j - 1] + (c != d), begin[j - 1])]
            value, where = min(options, key=lambda o: o[0])
            new.append(value)
            from_.append(where)
        cost, begin = new, from_
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    similarity = 1 - cost[end] / max(len(needle), end - begin[end], 1)
    return (similarity, begin[end], end) if similarity >= least and end > begin[end] else None


def normalize_with_positions(text: str) -> tuple[str, list[int]]:
    """Letters and digits in compatibility form without case, and where in the text each comes from."""
    out, places = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c):
            if x.isalnum():
                for f in x.casefold():
                    out.append(f)
                    places.append(i)
    return "".join(out), places


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """``normalize_with_positions`` without the positions; null stays null."""
    return texts.map(lambda t: None if t is None else normalize_with_positions(t)[0])


@F.pandas_udf(DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns; null if either is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def best_of(scores: Sequence[Column]) -> Column:
    """The greatest of several scores, nulls left out."""
    return F.greatest(*scores)
