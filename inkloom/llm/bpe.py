"""Byte-level BPE by speculation and verification, vectorised over whole batches.

1. Texts are cut into words by character classes (numpy, no regex engine).
2. Equal words of a batch are encoded once; equality is verified byte by byte.
3. A trie walk proposes the greedy longest-match tokens of all words at once.
4. Every adjacent pair of proposed tokens is tested for compatibility: a
   sequence is the merge result exactly if all its neighbours are compatible.
5. Only words with an incompatible pair are merged one merge at a time.

The vocabulary file is a parameter; it is read in place on each executor.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

DEFAULT_TOKENIZER = os.environ.get("INKLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Code points handled at once; bounds the memory of a batch.
CHUNK_CHARS = 700_000
#: Exactly merged words remembered by a worker.
CACHE_WORDS = 200_000
#: Words still walking when the walk turns scalar.
SCALAR_BELOW = 24
# The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
_U64 = np.uint64


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for at, kind in enumerate(map(unicodedata.category, everything)):
        if kind[0] == "L" or kind[0] == "N":
            out[at if at < 0xD800 else at + 0x800] = LETTER if kind[0] == "L" else NUMBER
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def word_starts(cp: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Mark the first code point of each word; ``text_start`` marks texts' first ones."""
    n = len(cp)
    kind = char_classes()[cp]
    white = kind >= WHITE
    group = np.minimum(kind, WHITE)
    start = text_start.copy()
    start[1:] |= group[1:] != group[:-1]
    # The last white-space character before a word stands alone, or joins the word if it is a space.
    first = np.flatnonzero(start[1:] & ~white[1:] & ~text_start[1:] & white[:-1]) + 1
    start[first - 1] = True
    start[first[kind[first - 1] == SPACE]] = False
    # Contractions.
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        wide = np.concatenate([cp, np.zeros(3, cp.dtype)])
        ends = np.concatenate([text_start, np.ones(3, bool)])
        one, two = wide[quote + 1], wide[quote + 2]
        has1 = ~ends[quote + 1]
        has2 = has1 & ~ends[quote + 2]
        short = has1 & np.isin(one, [ord(c) for c in "stmd"])
        long = has2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        start[quote[short | long] + 1] = False
        for hit, size in ((short, 2), (long, 3)):
            after = quote[hit] + size
            start[after[after < n]] = True
    return start


class _Table:
    """An open-addressing hash table from integer keys to int32, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2.5 + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            where, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[where], self.values[where] = keys[won], values[won]
            left = self.keys[at] != keys[todo]
            todo, at = todo[left], (at[left] + 1) & (size - 1)
        self.mask = size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U64) * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], -1)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The vocabulary in the forms that the walk, the pair test and the exact merging need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab = model["vocab"]
        special = {t for t in vocab if any(c not in letters for c in t)}
        token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special and not re.fullmatch(r"<\|.*\|>", t)}
        top = max(token_bytes) + 1
        self.byte_id = np.zeros(256, np.int32)
        for i, raw in token_bytes.items():
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.shift = 20
        self.pairs = _Table(left << self.shift | right, rank)
        self.rank = {(int(a), int(b)): (int(r), int(c)) for a, b, r, c in zip(left, right, rank, made)}
        # How each token was made: its order and its two parts.  A byte has order -1 and is its own part.
        self.order = np.full(top, -1, np.int64)
        self.left = np.arange(top, dtype=np.int64)
        self.right = np.arange(top, dtype=np.int64)
        self.order[made], self.left[made], self.right[made] = rank, left, right
        # The trie.
        node, edges, tokens = {b"": 0}, [], [-1]
        for i, raw in token_bytes.items():
            for size in range(1, len(raw) + 1):
                if raw[:size] not in node:
                    node[raw[:size]] = len(tokens)
                    tokens.append(-1)
                    edges.append((node[raw[: size - 1]] << 8 | raw[size - 1], node[raw[:size]]))
            tokens[node[raw]] = i
        self.node_token = np.array(tokens, np.int32)
        edge = np.array(edges, np.int64)
        self.edges = _Table(edge[:, 0], edge[:, 1].astype(np.int32))
        self.root = self.edges.get(np.arange(256, dtype=np.int64)).astype(np.int64)
        self.edge_map = None
        self._edge_list = edges
        self.exact: dict[bytes, list[int]] = {}

    # -- proposal ---------------------------------------------------------

    def propose(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words: the token ids, and the number of each word's tokens."""
        count = np.zeros(len(begin), np.int64)
        who, pos = np.flatnonzero(end > begin), begin[end > begin].astype(np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        scalar: dict[int, list[int]] = {}
        while len(who):
            if len(who) < SCALAR_BELOW:
                for w, p in zip(who.tolist(), pos.tolist()):
                    scalar[w] = self._walk(raw, p, int(end[w]))
                break
            stop = end[who]
            node = self.root[raw[pos]]
            token, size = self.node_token[node].copy(), np.ones(len(who), np.int64)
            live, depth = np.flatnonzero(pos + 1 < stop), 1
            at = node[live]
            while len(live):
                at = self.edges.get(at << 8 | raw[pos[live] + depth])
                on = at >= 0
                live, at = live[on], at[on].astype(np.int64)
                depth += 1
                known = self.node_token[at]
                full = known >= 0
                token[live[full]], size[live[full]] = known[full], depth
                on = pos[live] + depth < stop[live]
                live, at = live[on], at[on]
            steps.append((who, token))
            count[who] += 1
            pos = pos + size
            on = pos < stop
            who, pos = who[on], pos[on]
        rounds = count.copy()
        for w, ids in scalar.items():
            count[w] += len(ids)
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offset[-1], np.int32)
        for k, (w, ids) in enumerate(steps):
            out[offset[w] + k] = ids
        for w, ids in scalar.items():
            out[offset[w] + rounds[w] : offset[w + 1]] = ids
        return out, count

    def _walk(self, raw: np.ndarray, pos: int, stop: int) -> list[int]:
        if self.edge_map is None:
            self.edge_map = dict(self._edge_list)
        out, text, step, tokens = [], raw[pos:stop].tobytes(), self.edge_map, self.node_token
        at, n = 0, len(text)
        while at < n:
            node, best, size, d = 0, -1, 1, at
            while d < n and (node := step.get(node << 8 | text[d], -1)) >= 0:
                d += 1
                if tokens[node] >= 0:
                    best, size = int(tokens[node]), d - at
            out.append(best)
            at += size
        return out

    # -- verification -----------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay apart when their joined bytes are merged.

        The merges that build a's right edge and b's left edge are undone from
        the latest on; a merge across the border that comes before the part
        that would forbid it makes the pair incompatible.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.pairs.get(x << self.shift | y).astype(np.int64)
            bad = (across >= 0) & (across < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            ox, oy = self.order[x], self.order[y]
            whole = (ox < 0) & (oy < 0)
            # Of two equal orders the left token was made first, so the right one is undone first.
            undo_left = (ox > oy) & ~whole
            undo_right = ~undo_left & ~whole
            i = live[undo_left]
            limit[i], a[i] = ox[undo_left], self.right[x[undo_left]]
            i = live[undo_right]
            limit[i], b[i] = oy[undo_right] + 1, self.left[y[undo_right]]
            live = live[~whole]
        return good

    # -- exact merging ----------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """One word by its merges in order of rank, leftmost first."""
        known = self.exact.get(word)
        if known is not None:
            return known
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((made, ids[k])):
                    heapq.heappush(heap, (r[0], i, made, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, ids[h], made, r[1]))
        out = [i for i in ids if i >= 0]
        if len(self.exact) >= CACHE_WORDS:
            self.exact.clear()
        if len(word) <= 256:
            self.exact[word] = out
        return out

    # -- whole texts ------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts: the ids one after the other, and each text's number of ids."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        total = np.zeros(len(texts), np.int64)
        if not joined:
            return np.empty(0, np.int32), total
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        text_start = np.zeros(len(cp), bool)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        text_start[bounds[:-1][lengths > 0]] = True
        first = np.flatnonzero(word_starts(cp, text_start))
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        begin = byte_at[first]
        end = np.append(begin[1:], len(raw))
        member, keep = self._same_words(raw, begin, end)
        ids, count = self.propose(raw, begin[keep], end[keep])
        offset = np.concatenate([[0], np.cumsum(count)])
        word_of = np.repeat(np.arange(len(count)), count)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1]) if len(ids) > 1 else np.empty(0, np.int64)
        key = ids[inside].astype(np.int64) << self.shift | ids[inside + 1]
        pairs, which = np.unique(key, return_inverse=True)
        bad = ~self.compatible(pairs >> self.shift, pairs & ((1 << self.shift) - 1))[which] if len(pairs) else np.empty(0, bool)
        failed = np.unique(word_of[inside[bad]])
        if len(failed):
            merged = {int(w): np.array(self.merge(raw[begin[keep[w]] : end[keep[w]]].tobytes()), np.int32) for w in failed}
            parts, done = [], 0
            for w in failed.tolist():
                parts += [ids[done : offset[w]], merged[w]]
                done = offset[w + 1]
                count[w] = len(merged[w])
            ids = np.concatenate([*parts, ids[done:]])
            offset = np.concatenate([[0], np.cumsum(count)])
        # Unfold the words' ids to all their places.
        per_word = count[member]
        place = np.concatenate([[0], np.cumsum(per_word)])
        flat = ids[np.arange(place[-1]) - np.repeat(place[:-1], per_word) + np.repeat(offset[member], per_word)]
        text_words = np.searchsorted(first, bounds)
        return flat, place[text_words[1:]] - place[text_words[:-1]]

    @staticmethod
    def _same_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the number of its representative, and the representatives' words."""
        power = np.full(len(raw), 0x5851F42D4C957F2D, _U64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.concatenate([np.zeros(1, _U64), np.cumsum((raw.astype(_U64) + _U64(1)) * _U64(0xD6E8FEB86659FD93) * power, dtype=_U64)])
        inverse = _U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        back = np.full(len(raw), inverse, _U64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        size = end - begin
        value = (total[end] - total[begin]) * back[begin] ^ size.astype(_U64) * _U64(0x9E3779B97F4A7C15)
        _, keep, member = np.unique(value, return_index=True, return_inverse=True)
        twin = keep[member]
        same = size == size[twin]
        check = np.flatnonzero(same & (twin != np.arange(len(twin))))
        length = size[check]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differ = raw[np.repeat(begin[check], length) + step] != raw[np.repeat(begin[twin[check]], length) + step]
        if differ.any():
            same[np.unique(np.repeat(check, length)[differ])] = False
        alone = np.flatnonzero(~same)
        if len(alone):
            member = member.copy()
            member[alone] = len(keep) + np.arange(len(alone))
            keep = np.concatenate([keep, alone])
        return member, keep


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """Ranges of texts of about ``limit`` code points; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
