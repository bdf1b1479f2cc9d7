"""Shards of an inverted index in blocks of fixed size, and ranked retrieval over one of them.

A shard holds some documents.  A term's postings (document, occurrences) are cut into blocks of BLOCK; a
block is bit-packed, and its last document and its greatest impact stand outside, where they can be read
without decompressing it.  Nothing here knows about Spark; ranked_search.py deals out the shards.
"""

from __future__ import annotations

import struct

import numpy as np

from . import textops

BLOCK = 64
HEAD = struct.Struct("<8s4q")
MAGIC = b"UNDBMW01"
#: Intervals of documents that are scored at once.
STRIDE = 256


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight: whole numbers, division rounds down."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits a number needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, first: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Block i: count[i] values from first[i] on in width[i] bits each, from a whole byte on."""
    size = (count * width + 7) // 8
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    kind = count * 64 + width
    order = np.argsort(kind, kind="stable")
    order = order[size[order] > 0]
    for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else ():
        c, w = int(count[rows[0]]), int(width[rows[0]])
        for lo in range(0, len(rows), max(1, (1 << 20) // (c * w))):
            own = rows[lo : lo + max(1, (1 << 20) // (c * w))]
            bits = (values[first[own][:, None] + np.arange(c)][:, :, None] >> np.arange(w)) & 1
            out[at[own][:, None] + np.arange(size[own[0]])] = np.packbits(bits.astype(np.uint8).reshape(len(own), c * w), axis=1, bitorder="little")
    return out


def _unpack(data: np.ndarray, at: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Rows of BLOCK values, zero from count on.  data has 8 * 64 spare bytes at its end."""
    out = np.zeros((len(at), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(data[at[rows][:, None] + np.arange(8 * w)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = bits @ (1 << np.arange(w, dtype=np.int64))
    out[np.arange(BLOCK) >= count[:, None]] = 0
    return out


def encode(ids: np.ndarray, none: np.ndarray, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> bytes:
    """A shard of documents (ids, whether they have none, m) and postings, each document's terms once."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.append(head, len(term)))
    blocks = -(-df // BLOCK)
    owner = np.repeat(np.arange(len(df)), blocks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = head[owner] + place * BLOCK
    count = np.minimum(BLOCK, df[owner] - place * BLOCK)
    last = doc[first + count - 1] if len(first) else first
    gap = np.append(np.diff(doc), 1) - 1  # to the next posting; not used at a block's end
    inner = np.ones(len(doc), bool)
    inner[first + count - 1] = False
    gap[~inner] = 0
    most = lambda v: np.maximum.reduceat(v, first) if len(first) else first
    gap_width, tf_width = _bits(most(gap)), _bits(most(tf - 1))
    peak = most(impact(tf, m[doc]))
    gaps, tfs = _pack(gap, first, count - 1, gap_width), _pack(tf - 1, first, count, tf_width)
    parts = [ids.astype("<i8"), none.astype("u1"), m.astype("<i8"), term[head].astype("<u8"), df.astype("<u4"), last.astype("<u4"), peak.astype("<u4"), gap_width.astype("u1"), tf_width.astype("u1"), gaps, tfs]
    return HEAD.pack(MAGIC, len(ids), len(df), len(owner), len(gaps)) + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard as read.  Blocks are decompressed when a search first needs them."""

    def __init__(self, raw: bytes):
        magic, docs, terms, blocks, gap_bytes = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not an index shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.ids, self.none, self.m = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
        self.terms, self.df = take("<u8", terms), take("<u4", terms).astype(np.int64)
        self.last, self.peak = take("<u4", blocks).astype(np.int64), take("<u4", blocks).astype(np.int64)
        self.gap_width, self.tf_width = take("u1", blocks).astype(np.int64), take("u1", blocks).astype(np.int64)
        spare = np.zeros(8 * 64, np.uint8)
        self.gaps = np.concatenate([take("u1", gap_bytes), spare])
        self.tfs = np.concatenate([take("u1", len(raw) - at), spare])
        per = -(-self.df // BLOCK)
        self.block = np.append(0, np.cumsum(per))  # a term's first block, and the end
        owner = np.repeat(np.arange(terms), per)
        place = np.arange(blocks) - self.block[owner]
        self.count = np.minimum(BLOCK, self.df[owner] - place * BLOCK)
        self.posting = np.append(0, np.cumsum(self.count))
        gap_size, tf_size = ((self.count - 1) * self.gap_width + 7) // 8, (self.count * self.tf_width + 7) // 8
        self.gap_at, self.tf_at = np.cumsum(gap_size) - gap_size, np.cumsum(tf_size) - tf_size
        self.ready = np.zeros(blocks, bool)
        self.doc = np.zeros(int(self.posting[-1]), np.uint32)
        self.impact = np.zeros(int(self.posting[-1]), np.uint32)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """In how many documents each term is."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.df[at], 0)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        for lo in range(0, len(blocks), 4096):
            own = blocks[lo : lo + 4096]
            count = self.count[own]
            gap = _unpack(self.gaps, self.gap_at[own], count - 1, self.gap_width[own])
            step = gap + (np.arange(BLOCK) < count[:, None] - 1)
            doc = self.last[own][:, None] - np.cumsum(step[:, ::-1], axis=1)[:, ::-1]
            tf = _unpack(self.tfs, self.tf_at[own], count, self.tf_width[own]) + 1
            there = np.arange(BLOCK) < count[:, None]
            at = textops.spans(self.posting[own], count)
            doc = doc[there]
            self.doc[at] = doc
            self.impact[at] = impact(tf[there], self.m[doc])
            self.ready[own] = True

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best of this shard with a score above 0, and all that tie with the
        last of them.  terms are distinct."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        held = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else none
        held = held[weights[held] > 0]
        if not len(held):
            return none, none
        begin, end = self.block[at[held]], self.block[at[held] + 1]
        weight = weights[held]
        # Between two neighbouring ends of blocks every term stays in one block: shallow moves of all
        # pointers to such an interval need the ends alone, and give a bound of the scores within it.
        ends = np.unique(np.concatenate([self.last[a:b] for a, b in zip(begin, end, strict=True)]))
        block = np.full((len(held), len(ends)), -1, np.int64)
        bound = np.zeros(len(ends), np.int64)
        for t, (a, b) in enumerate(zip(begin, end, strict=True)):
            j = a + np.searchsorted(self.last[a:b], ends)
            own = j < b
            block[t, own] = j[own]
            bound[own] += weight[t] * self.peak[j[own]]
        interval = np.searchsorted(ends, np.arange(len(self.ids)))  # past the end: no posting
        chosen = np.zeros(len(ends) + 1, bool)
        done = np.zeros(len(ends), bool)
        score = np.zeros(len(self.ids), np.int64)
        best, floor = none, 1

        def evaluate(intervals: np.ndarray) -> None:
            nonlocal best, floor
            chosen[:] = False
            chosen[intervals] = done[intervals] = True
            for t in range(len(held)):
                blocks = np.unique(block[t, intervals])
                blocks = blocks[blocks >= 0]
                self.decompress(blocks)
                own = textops.spans(self.posting[blocks], self.count[blocks])
                own = own[chosen[interval[self.doc[own]]]]
                score[self.doc[own]] += weight[t] * self.impact[own].astype(np.int64)
            best = np.concatenate([best, np.flatnonzero(chosen[interval] & (score >= floor))])
            if len(best) > k:
                floor = max(floor, int(np.partition(score[best], len(best) - k)[len(best) - k]))
                best = best[score[best] >= floor]

        # the most promising intervals first, for a threshold; then all others in order of documents
        evaluate(np.sort(np.argsort(-bound, kind="stable")[:STRIDE]))
        pointer = 0
        while True:
            ahead = pointer + np.flatnonzero((bound[pointer:] >= floor) & ~done[pointer:])[:STRIDE]
            if not len(ahead):
                return best, score[best]
            evaluate(ahead)
            pointer = int(ahead[-1]) + 1
