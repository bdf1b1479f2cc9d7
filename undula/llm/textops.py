"""Vectorised text primitives that run inside Spark tasks.

Every operator of this subpackage that looks at words receives Arrow batches of
(key, text) and works on slices of a few megabytes: the UTF-8 bytes of many
documents in one NumPy array, with the documents' offsets.  Nothing here knows
about Spark; the operators decide how work is partitioned and shuffled.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: `[\x20\x09-\x0D]` separates words.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and what is not ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x80:] = True

#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A byte's value: differences of two have at most seven factors of two.
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_place = np.zeros(0, np.uint64)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """work, and after it the task's freed memory goes back to the system: Python workers are kept for
    later tasks, and what they hold back counts for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted: by a sort, which is many times faster on whole numbers than the hash
    table behind numpy's own function."""
    values = np.sort(values, axis=None)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def places(n: int) -> np.ndarray:
    """An odd random-looking factor for each of the first n places of a word.  They have no structure
    (powers of a number have: words that repeat a pattern at doubling distances would get equal sums)."""
    global _place
    if len(_place) < n:
        _place = mix((np.arange(max(n, 1024), dtype=np.uint64) + np.uint64(1)) * _STEP) | np.uint64(1)
    return _place[:n]


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The text column as one array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string())


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yields (first row, row after the last, bytes, offsets of the rows and the end).

    A slice holds at most `limit` bytes, or one longer row.
    """
    text = filled(column)
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; row i has words first[i] to first[i + 1]."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_word = word[buf]
    cut = np.ones(n + 1, bool)  # cut[i]: no word runs from byte i - 1 into byte i
    cut[1:n] = ~(is_word[1:] & is_word[:-1])
    cut[offsets] = True
    starts = np.flatnonzero(is_word & cut[:n])
    ends = np.flatnonzero(is_word & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(first[-1] + lens[-1])
    small = np.int32 if max(total, len(buf)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=small)
    at -= np.repeat(first.astype(small), lens)  # place within its range
    value = places(int(lens.max()))[at]
    at += np.repeat(starts.astype(small), lens)
    value *= (_BYTE_LOWER if lower else _BYTE)[buf[at]]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64))


def same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether byte range i of buf equals byte range i of other."""
    lens = ends - starts
    equal = lens == other_ends - other_starts
    rows = np.flatnonzero(equal & (lens > 0))
    if len(rows):
        n = lens[rows]
        differ = buf[spans(starts[rows], n)] != other[spans(other_starts[rows], n)]
        if differ.any():
            equal[rows] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return equal


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, back): the first place of each distinct word, in order of places, and which of them each word
    is.  Words are grouped by hash and then compared byte by byte; should two have one hash, the slice is
    grouped by the words themselves."""
    _, at, back = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
    if not same(buf, starts, ends, buf, starts[at][back], ends[at][back]).all():
        raw, number = buf.tobytes(), {}
        back = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return np.unique(back, return_index=True)[1], back
    order = np.argsort(at)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    return at[order], rank[back]


def windows(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The hash of every n consecutive values (len(h) - n + 1 of them), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, width, parts = h, 1, []
    rest = n
    while rest:
        if rest & 1:
            parts.append((width, out))
        rest >>= 1
        if rest:
            out = out[: len(out) - width] + np.uint64(pow(base, width, 1 << 64)) * out[width:]
            width *= 2
    total, done, count = np.zeros(len(h) - n + 1, np.uint64), 0, len(h) - n + 1
    for width, part in parts:
        total += np.uint64(pow(base, done, 1 << 64)) * part[done : done + count]
        done += width
    return mix(total)


def window_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, row): for every window start of `windows` over a whole slice, whether it stays within
    one row, and that row."""
    total = int(first[-1])
    count = max(0, total - n + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    return np.arange(count) + n <= first[row + 1], row


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + lens[0] - 1, starts[1] .. and so on."""
    total = int(lens.sum())
    return np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
