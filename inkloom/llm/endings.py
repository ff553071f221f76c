"""Whether a text stops at the end of a sentence that only lacks its final stop.

Two rules come first: a word that can't be the last of a sentence, and a piece
of a word, one that stands nowhere inside a text while longer words begin with
it.  The rest goes to a logistic regression over hashed features of the last
words and letters, trained here on a bounded sample of texts that do end in a
final stop: their sentences without the stop are whole, the same sentences cut
at random places are not.  The bounds of the sample are ``SAMPLE_TEXTS``,
``SAMPLE_CHARS`` and ``SAMPLE_SENTENCES``; words are counted and endings scored
in all texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in the training sample, at most.
SAMPLE_TEXTS = 6000
#: Code points of the passage that is taken of a sampled text, at a place drawn by hash.
SAMPLE_CHARS = 1200
#: Sentences of a passage that are learned from, drawn at random.
SAMPLE_SENTENCES = 6
BITS = 18
EPOCHS = 4
CUTS = 4

# Marks that end a sentence, marks that close after them, marks that let a line trail off.
STOPS = ".!?。！？｡"
CLOSERS = "\"'”’“』」»）)】]*"
TRAILS = "—–―…‥"
# Words that stand before another one, in Latin script.
NEVER_LAST = "a an the and or but nor if than because although unless whose my your our their its every of into onto toward towards during between among el la los las un una unos unas de del al y o ni si pero porque aunque mi tu su sus mis tus con en por para que cuyo cuya desde hasta hacia und oder aber weil wenn dass ein des dem mein meinen meinem dein deinen deinem unser unseren von vom zum zur beim für ohne gegen".split()
# Characters that stand before another word, in Chinese and Japanese.
NEVER_LAST_WIDE = "的和与在把被对从到给向往又跟让叫将或则且若为のをがはにでへとや"
#: Code points of an ending in which its last word is looked for; a longer one is no word of a list.
LONGEST_WORD = 100
_LETTERS = r"[a-zß-öø-ɏ]++(?:['’\-][a-zß-öø-ɏ]++)*+"
_SENTENCE = re.compile(rf"[^{re.escape(STOPS + TRAILS)}\n]+[{re.escape(STOPS)}]")
_BREAK = re.compile(rf"[{re.escape(STOPS + TRAILS)}\n*]")
_OPENERS = " \t\"'“„«「『(（¿¡>-*"
#: Code points before an ending in which the start of its sentence is looked for.
SENTENCE_CHARS = 240
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]")


def _shape(word: str) -> str:
    if not word:
        return "-"
    if word[0].isdigit():
        return "9"
    if ord(word[0]) >= 0x2E80:
        return "c"
    return ("A" if word[0].isupper() else "a" if word[0].isalpha() else ".") + str(min(len(word), 8))


def tail_features(text: str, known: frozenset[int] | set[int]) -> list[int]:
    """Hashed features of the end of ``text``, always as many."""
    tail = text[-80:]
    blank = tail[-1:].isspace()
    tail = tail.rstrip()
    words = _WORD.findall(tail)[-4:]
    w = [""] * (4 - len(words)) + words
    last, before = w[3], w[2]
    wide = ord(tail[-1]) >= 0x2E80 if tail else False
    seen = "c" if wide else "k" if zlib.crc32(last.lower().encode()) in known else "u"
    out = ["blank" if blank else "tight", f"1{last}", f"2{before} {last}", f"3{w[1]} {before} {last}", f"4{w[0]} {w[1]} {before} {last}", f"k{seen}{_shape(last)}", f"p{before}|{seen}{_shape(last)}", f"q{w[1]} {before}|{seen}{_shape(last)[:1]}", f"r{w[0]} {w[1]} {before}|{seen}"]
    out += [f"s{n}{last[-n:]}{'' if len(last) > n else '^'}" for n in (1, 2, 3, 4, 5)]
    out += [f"c{n}{tail[-n:]}" for n in (1, 2, 3, 4, 5, 6, 8, 10, 12)]
    # The sentence so far: how it began, how many words and clauses it has.
    sentence = _BREAK.split(text[-SENTENCE_CHARS:].rstrip())[-1].strip(_OPENERS)
    begun = _WORD.findall(sentence[:60])
    start = sentence[:2] if wide else " ".join(begun[:2])
    clauses = sum(sentence.count(c) for c in ",，、;；:：")
    size = len(sentence) if wide else sentence.count(" ")
    out += [f"x{start}|{clauses}|{size}", f"y{start}|{clauses}|{before}", f"z{start}|{clauses}|{seen}{tail[-1:] if wide else _shape(last)}", f"w{start[:1] if wide else begun[:1]}|{clauses}|{tail[-2:] if wide else last}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) >> (32 - BITS) for x in out]


@dataclass
class EndingModel:
    weights: np.ndarray
    known: frozenset[int]

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-odds that each text stops at the end of a sentence."""
        if not texts:
            return np.empty(0)
        return self.weights[np.array([tail_features(t, self.known) for t in texts])].sum(1)


def train(texts: list[str], seed: int = 7) -> EndingModel:
    """Fit the model; without any usable sentence every score is 0."""
    rng = np.random.default_rng(seed)
    vocabulary_texts, training = texts[::2], texts[1::2]
    known: set[int] = set()
    for t in vocabulary_texts:
        known.update(zlib.crc32(w.lower().encode()) for w in _WORD.findall(t))
    rows, labels = [], []
    for t in training:
        spans = [m.span() for m in _SENTENCE.finditer(t) if m.end() - m.start() >= 6]
        for i in sorted(rng.permutation(len(spans))[:SAMPLE_SENTENCES].tolist()):
            begin, end = spans[i]
            whole = t[:end - 1]
            rows.append(tail_features(whole, known))
            labels.append(1.0)
            for k in rng.integers(begin + 2, end - 1, CUTS).tolist():
                part = whole[:k]
                rows.append(tail_features(part, known))
                labels.append(0.0)
    weights = np.zeros(1 << BITS)
    if rows:
        x, y = np.array(rows), np.array(labels)
        square = np.full(1 << BITS, 1e-8)
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
                p = 1 / (1 + np.exp(-np.clip(weights[x[at]].sum(1), -30, 30)))
                g = np.repeat((p - y[at]) * np.where(y[at] > 0, CUTS, 1.0), x.shape[1])
                i = x[at].ravel()
                total = np.bincount(i, g, 1 << BITS) if len(i) > 20000 else None
                if total is None:
                    u, inv = np.unique(i, return_inverse=True)
                    s = np.bincount(inv, g)
                else:
                    u = np.flatnonzero(total)
                    s = total[u]
                square[u] += s * s
                weights[u] -= 0.3 * s / np.sqrt(square[u])
    return EndingModel(weights.astype(np.float32).astype(np.float64), frozenset(known))


def passage(text: Column, place: Column) -> Column:
    """``SAMPLE_CHARS`` code points of a text, at a place drawn by a hash; a shorter text is taken whole."""
    return F.substring(text, (F.pmod(place, F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))) + 1).cast("int"), F.lit(SAMPLE_CHARS))


def sample_share(rows: int, size: int = SAMPLE_TEXTS) -> float:
    """The share of all rows that is taken by hash before the bound, so that no task sends many."""
    return min(1.0, 4.0 * size / max(1, rows))


def drawn(h: Column, share: float) -> Column:
    """Whether a row with the hash ``h`` is among that share."""
    return F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def sample_texts(df: DataFrame, text: str, key: Column, size: int = SAMPLE_TEXTS) -> list[str]:
    """Passages of a bounded sample of texts that end in a final stop, the same in every run: those with the least hashes."""
    h = F.xxhash64(key, text)
    chosen = df.filter(F.col(text).isNotNull()).withColumn("_h", h).filter(drawn(F.col("_h"), sample_share(df.count(), size))).filter(stopped(F.col(text)))
    return least_passages(chosen.select(passage(F.col(text), F.abs(F.xxhash64("_h"))).alias("t"), F.col("_h").alias("h")), size)


def least_passages(passages: DataFrame, size: int = SAMPLE_TEXTS) -> list[str]:
    """The passages ``t`` with the least hashes ``h``, on the driver: at most ``size`` rows of ``SAMPLE_CHARS`` code points."""
    return [r["t"] for r in passages.orderBy("h", "t").limit(size).collect()]


# -- abrupt endings -------------------------------------------------------


def last_word(text: Column) -> Column:
    """The word in Latin script that a text ends with, in lower case; empty if it ends otherwise."""
    end = F.right(F.rtrim(F.translate(text, "\n\r\t", "   ")), F.lit(LONGEST_WORD))
    return F.regexp_extract(F.lower(end), f"({_LETTERS})\\s*\\z", 1)


def stops_before(text: Column) -> Column:
    """Whether a text ends with a word that can't be the last of its sentence."""
    return last_word(text).isin(NEVER_LAST) | F.right(F.rtrim(F.translate(text, "\n\r\t", "   ")), F.lit(1)).isin(list(NEVER_LAST_WIDE))


def inner_words(df: DataFrame, text: str) -> DataFrame:
    """``word``: every word in Latin script that something follows in some text, once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({_LETTERS})(?=[^a-zß-öø-ɏ'’\\-])"), F.lit(1))
    return df.select(F.explode(F.array_distinct(found)).alias("word")).distinct()


def pieces_of_words(last: DataFrame, words: DataFrame) -> DataFrame:
    """``word`` of ``last`` that is no word inside any text, while longer ones begin with it."""
    begun = words.filter(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word")).distinct()
    return last.select("word").filter("word <> ''").distinct().join(words, "word", "left_anti").join(begun, "word", "left_semi")


# -- structure ------------------------------------------------------------


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def unclosed(text: Column) -> Column:
    """Whether a quotation or a bracket is still open; a low opening quote is closed by either high one."""
    low, high, close = _count(text, "„"), _count(text, "“"), _count(text, "”")
    curly = F.when(low > 0, (low > high + close) | (high - low > close)).otherwise(high > close)
    straight = (_count(text, '"') % 2 == 1) & ~text.rlike('"\\s*\\z')
    pairs = [(_count(text, a) > _count(text, b)) for a, b in (("(（", ")）"), ("「", "」"), ("『", "』"), ("[【", "]】"), ("«", "»"))]
    out = curly | straight
    for p in pairs:
        out = out | p
    return F.when(text.rlike(r"[„“\"(（「『\[【«]"), out).otherwise(F.lit(False))


def stopped(text: Column) -> Column:
    """Whether a text ends in a final stop, with or without closing marks."""
    return text.rlike(f"(?s)[{re.escape(STOPS)}][{re.escape(CLOSERS)}]*\\s*\\z")


def trails_off(text: Column) -> Column:
    """Whether a text ends in a dash or an ellipsis."""
    return text.rlike(f"(?s)(?:[{re.escape(TRAILS)}]|\\.\\.\\.|--)[{re.escape(CLOSERS)}]*\\s*\\z")
