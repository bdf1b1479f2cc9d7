"""Context-tree weighting over bytes, as vectorised steps on sorted tables of counts.

A byte is eight binary decisions, named by the node 1..255 of its binary tree.  Each decision has a tree of
contexts: the last byte before it, the last two, and so on to `depth`.  A context node with counts (a, b)
has the Krichevsky-Trofimov probability Pe(a, b) of its whole sequence, and the weighted probability
Pw = Pe at the greatest depth, else Pw = Pe / 2 + (product of the Pw of the contexts one byte longer) / 2.
Since Pe depends on counts alone, a corpus in any order and any number of parts gives one tree.

After training, the share of a context's own estimate is Pe / (2 Pw), and what is left goes to the longer
context; the probability of a bit is that mixture down the path of its contexts.  A context that training
never saw is no node of the tree: the path ends at the one before it, whose estimate takes all that is
left.  A decision that training never saw at all has probability 1/2.

Texts are UTF-8 with A-Z lower-cased.  Byte 255, which UTF-8 never uses, stands before a text and is its
end.  A key packs the contexts of one byte, the nearest context byte highest and the byte itself lowest, so
that sorted keys hold every context as one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGE = 255
#: Contexts of up to SPLIT - 1 bytes are handled together, longer ones by their first SPLIT bytes.
SPLIT = 3
#: Positions of a text whose keys are made at once.
STRETCH = 1 << 20
_HALF = np.log(0.5)
_SMALL = np.arange(64.0)
_HALVES = np.append(0.0, np.cumsum(np.log(_SMALL + 0.5)))  # log of gamma(n + 1/2) / gamma(1/2)
_FACTORIALS = np.append(0.0, np.cumsum(np.log(_SMALL + 1)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 64 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _by_table(n: np.ndarray, table: np.ndarray, shift: float, less: float) -> np.ndarray:
    out = table[np.minimum(n, 64)]
    large = np.flatnonzero(n > 64)
    out[large] = _log_gamma(n[large] + shift) - less
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log Pe of sequences of a zeros and b ones."""
    less = 0.5 * np.log(np.pi)
    return _by_table(a, _HALVES, 0.5, less) + _by_table(b, _HALVES, 0.5, less) - _by_table(a + b, _FACTORIALS, 1.0, 0.0)


def keys(buf: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, row of each) of all bytes and ends of the rows of a slice of lower-cased texts."""
    raw = buf.tobytes()
    gap = bytes([EDGE]) * depth
    line = np.frombuffer(gap + gap.join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]) + bytes([EDGE]), np.uint8)
    lens = np.diff(offsets)
    start = depth + np.cumsum(lens + depth) - (lens + depth)
    for lo in range(depth, len(line), STRETCH):
        hi = min(len(line), lo + STRETCH)
        key = line[lo:hi].astype(np.uint64)
        for j in range(1, depth + 1):
            key |= line[lo - j : hi - j].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
        place = np.arange(lo, hi)
        own = np.searchsorted(start, place, "right") - 1
        inside = place - start[own] <= lens[own]
        yield key[inside], own[inside]


def summed(key: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each n over equal ones."""
    if not len(key):
        return key, *n
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begin], *(np.add.reduceat(x[order], begin) for x in n)


def _shorter(ids: np.ndarray) -> np.ndarray:
    """(context, low byte) without the farthest byte of the context."""
    return ((ids >> 16) << 8) | (ids & 0xFF)


class Level:
    """The nodes of one depth for one of the eight decisions: ids (context, node), counts, log Pw and the
    share of the own estimate."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_kt(zeros, ones)
        self.log_pw = own if longer is None else np.logaddexp(_HALF + own, _HALF + longer)
        self.share = np.ones(len(ids)) if longer is None else np.exp(np.minimum(0.0, _HALF + own - self.log_pw))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def estimate(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        zeros, ones = self.zeros[at], self.ones[at]
        return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)

    def shorter(self) -> tuple[np.ndarray, ...]:
        """(ids, zeros, ones, sum of log Pw) of the contexts one byte shorter."""
        return summed(_shorter(self.ids), self.zeros, self.ones, self.log_pw)


def levels(key: np.ndarray, n: np.ndarray, depth: int, decision: int) -> list[Level]:
    """The levels SPLIT to depth of one decision, of sorted distinct keys that hold whole runs of SPLIT bytes."""
    key, n = key[n > 0], n[n > 0]
    out: list[Level] = []
    ids, count, longer = key, n, None
    for d in range(depth, SPLIT - 1, -1):
        if d < depth:
            ids, count = summed(_shorter(ids), count)
        low = ids & 0xFF
        node = ((ids >> 8) << 8) | (1 << decision) | (low >> (8 - decision))
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        bit = (low >> (7 - decision)) & 1
        total, ones = (np.add.reduceat(x, begin) if len(begin) else count for x in (count, count * bit))
        if out:
            parent = _shorter(out[-1].ids)
            longer = np.bincount(np.searchsorted(node[begin], parent), weights=out[-1].log_pw, minlength=len(begin))
        out.append(Level(node[begin], total - ones, ones, longer))
    return out[::-1]


class Mixture:
    """The mixture down to contexts of SPLIT - 1 bytes: for each node of those depths and each bit, the
    probability if the path ends there, what is mixed in if it goes on, and the weight that is left."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        order = np.argsort(ids)
        found = [Level(ids[order], zeros[order], ones[order], longer[order])]
        while len(found) < SPLIT:
            found.append(Level(*found[-1].shorter()))
        self.tables = []
        for d, level in enumerate(reversed(found)):
            if d:
                up = self.tables[-1]
                at = np.searchsorted(up[0], _shorter(level.ids))
                mixed, left = up[2][:, at], up[3][at]
            else:
                mixed, left = np.zeros((2, len(level.ids))), np.ones(len(level.ids))
            own = np.stack([level.estimate(np.arange(len(level.ids)), np.full(len(level.ids), b)) for b in (False, True)])
            self.tables.append((level.ids, mixed + left * own, mixed + left * level.share * own, left * (1 - level.share)))

    def start(self, key: np.ndarray, depth: int, decision: int) -> tuple[np.ndarray, ...]:
        """(bit, probability so far, mixed in, weight left, whether the path goes on) of each key."""
        low = key & 0xFF
        bit = (low >> (7 - decision)) & 1
        p, mixed, left = np.full(len(key), 0.5), np.zeros(len(key)), np.ones(len(key))
        on = np.ones(len(key), bool)
        for d, (ids, ends, goes, rest) in enumerate(self.tables):
            node = ((key >> (8 * (depth - d) + 8)) << 8) | (1 << decision) | (low >> (8 - decision))
            at = np.minimum(np.searchsorted(ids, node), max(0, len(ids) - 1))
            on &= (ids[at] == node) if len(ids) else False
            own = np.flatnonzero(on)
            b, at = bit[own], at[own]
            p[own], mixed[own], left[own] = ends[b, at], goes[b, at], rest[at]
        return bit, p, mixed, left, on


def log10_probabilities(key: np.ndarray, n: np.ndarray, depth: int, mixture: Mixture) -> np.ndarray:
    """log10 of the probability of each key's byte in its context.  Keys are sorted, distinct, and hold
    whole runs of SPLIT bytes; n are their counts in training, 0 for those that training never saw."""
    out = np.zeros(len(key))
    for decision in range(8):
        bit, p, mixed, left, on = mixture.start(key, depth, decision)
        low = key & 0xFF
        for d, level in enumerate(levels(key, n, depth, decision), SPLIT):
            rows = np.flatnonzero(on)
            node = ((key[rows] >> (8 * (depth - d) + 8)) << 8) | (1 << decision) | (low[rows] >> (8 - decision))
            at = level.find(node)
            on[rows[at < 0]] = False
            rows, at = rows[at >= 0], at[at >= 0]
            own = level.estimate(at, bit[rows] == 1)
            p[rows] = mixed[rows] + left[rows] * own
            mixed[rows] += left[rows] * level.share[at] * own
            left[rows] *= 1 - level.share[at]
        out += np.log10(p)
    return out
