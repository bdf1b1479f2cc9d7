"""Byte-level BPE over many words at once, and the public byte_bpe_50k.json vocabulary.

`pretokens` cuts text as the vocabulary's pattern does
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
but as array operations over a slice of documents; `Merger` applies the merges to all distinct words
of a slice in step, always the pair of lowest rank in each word.  Words over LONG bytes, whose steps
would be many, are merged one by one from a heap of their pairs.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np

SPECIAL = b"<|endoftext|>"

# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
LONG = 256


@cache
def char_class() -> np.ndarray:
    """The class of every code point."""
    import regex

    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte place, code point) of every character of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    point = lead.copy()
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        long = np.flatnonzero((lead >= low) & (lead < high))
        if len(long):
            value = lead[long] & keep
            for k in range(1, more + 1):
                value = (value << 6) | (buf[np.minimum(at[long] + k, len(buf) - 1)] & 0x3F)
            point[long] = np.minimum(value, 0x10FFFF)
    return at, point


def pretokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the byte ranges of all pretokens; row i has first[i] to first[i + 1].

    The special token's text is one pretoken, and cuts the text around it.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    raw, special, cuts = buf.tobytes(), [], offsets
    found = raw.find(SPECIAL)
    while found >= 0:
        end = found + len(SPECIAL)
        if np.searchsorted(offsets, found, "right") == np.searchsorted(offsets, end, "left"):
            special.append(found)
            found = raw.find(SPECIAL, end)
        else:
            found = raw.find(SPECIAL, found + 1)
    if special:
        cuts = np.unique(np.concatenate([offsets, special, np.array(special) + len(SPECIAL)]))
    at, point = code_points(buf)
    kind = char_class()[point]
    m = len(at)
    head = np.zeros(m + 1, bool)  # first character of a row
    head[np.searchsorted(at, cuts)] = True
    head[m] = True
    same = np.zeros(m, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~head[1:m]
    blank = point == 0x20
    after_blank = np.zeros(m, bool)
    after_blank[1:] = blank[:-1] & ~head[1:m]
    next_solid = np.zeros(m, bool)
    next_solid[:-1] = (kind[1:] != SPACE) & ~head[1:m]
    space = kind == SPACE
    start = np.where(space, ~same | next_solid, ~same & ~after_blank)
    quote = np.flatnonzero((point == 0x27) & start)
    if len(quote):
        ahead = [np.where((quote + k < m) & ~np.logical_or.reduce([head[np.minimum(quote + j, m)] for j in range(1, k + 1)]), point[np.minimum(quote + k, m - 1)], 0) for k in (1, 2)]
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = ((ahead[0] == ord("r")) & (ahead[1] == ord("e"))) | ((ahead[0] == ord("v")) & (ahead[1] == ord("e"))) | ((ahead[0] == ord("l")) & (ahead[1] == ord("l")))
        for mask, size in ((one, 2), (two, 3)):
            q = quote[mask]
            start[q + 1] = False
            start[q[q + size < m] + size] = True
    if special:
        inside = np.searchsorted(at, special)
        for i in inside:
            start[i] = True
            start[i + 1 : i + len(SPECIAL)] = False
            if i + len(SPECIAL) < m:
                start[i + len(SPECIAL)] = True
    starts = at[start]
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def alphabet() -> str:
    """The character that stands for each byte: printable ones for themselves, the others for 256, 257, ..."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256))


class StaticMap:
    """uint64 keys to int32 values: levels of first-come slots, each for what the one before left."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.bits = bits
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        while len(keys):
            slot = self._slot(keys, len(self.levels))
            own, value = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.full(1 << bits, -1, np.int32)
            first = np.unique(slot, return_index=True)[1]
            own[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((own, value))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED270B * level) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        for level, (own, value) in enumerate(self.levels):
            slot = self._slot(keys, level)
            hit = own[slot] == keys
            out[hit] = value[slot[hit]]
        return out


class Merger:
    """The merges of a tokenizers byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in spec["model"]["merges"]]
        self.byte_id = np.array([vocab[c] for c in alphabet()], np.int32)
        byte_of = {c: b for b, c in enumerate(alphabet())}
        size = max(max(vocab.values()), max(x["id"] for x in spec["added_tokens"])) + 1
        pieces = [b""] * size
        for piece, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in piece)
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            pieces[i] = content
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank_of = {int(a) << 32 | int(b): k for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.rank = StaticMap(left << np.uint64(32) | right, np.arange(len(merges)), 18)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The merges of one word in order of rank and place, whatever its length."""
        n, rank = len(ids), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, (a, b) in enumerate(zip(ids[:-1], ids[1:], strict=True)) if (r := rank.get(a << 32 | b)) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            # places merged meanwhile hold -1, or another pair
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heappush(heap, new * n + i)
            h = before[i]
            if h >= 0 and (new := rank.get(ids[h] << 32 | ids[i])) is not None:
                heappush(heap, new * n + h)
        return [x for x in ids if x >= 0]

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of each byte range, first[i] to first[i + 1]."""
        lens = ends - starts
        word = np.repeat(np.arange(len(starts)), lens)
        at = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
        ids = self.byte_id[buf[at]]
        for content, i in self.special.items():
            for w in np.flatnonzero(lens == len(content)):
                if buf[starts[w] : ends[w]].tobytes() == content:
                    own = np.flatnonzero(word == w)
                    ids[own[0]] = i
                    keep = np.ones(len(ids), bool)
                    keep[own[1:]] = False
                    ids, word = ids[keep], word[keep]
        done_ids, done_word = [], []
        none = np.int32(1 << 30)
        long = np.flatnonzero(lens > LONG)
        if len(long):
            edge = np.searchsorted(word, np.append(long, long + 1)).reshape(2, -1)
            for w, lo, hi in zip(long.tolist(), *edge.tolist(), strict=True):
                got = self.merge_long(ids[lo:hi].tolist())
                done_ids.append(np.array(got, np.int32))
                done_word.append(np.full(len(got), w))
            rest = ~np.isin(word, long)
            ids, word = ids[rest], word[rest]
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            got = self.rank.get(ids[inside].astype(np.uint64) << np.uint64(32) | ids[inside + 1].astype(np.uint64))
            rank[inside] = np.where(got < 0, none, got)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(ids)))
            best = np.repeat(least, size)
            open_ = best < none
            if not open_.all():
                done_ids.append(ids[~open_])
                done_word.append(word[~open_])
                ids, word, rank, best = ids[open_], word[open_], rank[open_], best[open_]
                if not len(ids):
                    break
            hit = rank == best
            # of overlapping hits (x x x) every other one merges, from the left
            run = np.flatnonzero(hit)
            new = np.append(True, np.diff(run) > 1)
            length = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
            run = run[length % 2 == 0]
            ids[run] = self.merged[rank[run]]
            keep = np.ones(len(ids), bool)
            keep[run + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(starts) + 1))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each range of ids; bytes that aren't UTF-8 become U+FFFD."""
        lens = self.piece_len[ids]
        total = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(total[-1]) - np.repeat(total[:-1], lens) + np.repeat(self.piece_start[ids], lens)
        raw = self.piece_bytes[at].tobytes()
        edge = total[first]
        out = [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


@cache
def merger(path: str) -> Merger:
    return Merger(path)
