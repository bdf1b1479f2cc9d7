"""Uncompressed AVI files: their layout, reading and writing.  Nothing here knows about Spark.

Frames have one size, so every offset of a file follows from the number of frames: a file is written from
its first byte to its last without going back, and a stretch of frames is read without walking to it.
Beyond RIFF_BYTES a file goes on in further RIFF lists, with an index of each list's chunks and a super
index over them (OpenDML), whose offsets have 64 bits.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of frames in one RIFF list; sizes of lists have 32 bits.
RIFF_BYTES = 1 << 30
_FRAME = b"00db"


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


@dataclass(frozen=True)
class Layout:
    """Where the frames of a file are."""

    h: int  # negative: rows from the top
    w: int
    fps: float
    frames: int
    starts: tuple[tuple[int, int], ...]  # (number of a frame, place of its data) at the start of each even stretch

    @property
    def size(self) -> int:
        return abs(self.h) * ((self.w * 3 + 3) // 4 * 4)

    @property
    def step(self) -> int:
        """Bytes from a frame to the next one of an even stretch."""
        return 8 + self.size + self.size % 2

    def place(self, frame: int) -> int:
        number, at = self.starts[bisect_right(self.starts, frame, key=lambda s: s[0]) - 1]
        return at + (frame - number) * self.step

    def runs(self, first: int, last: int, most: int) -> Iterator[tuple[int, int]]:
        """Frames first to last in turn, as (first, last) of up to `most` that follow each other evenly."""
        while first < last:
            k = bisect_right(self.starts, first, key=lambda s: s[0])
            end = min(last, first + most, self.starts[k][0] if k < len(self.starts) else last)
            yield first, end
            first = end


def encode(data: np.ndarray, h: int, w: int) -> bytes:
    """RGB values as a stored frame: rows bottom-up, blue first, padded."""
    body = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    body[:, : 3 * w] = data.astype(np.uint8).reshape(h, w, 3)[::-1, :, ::-1].reshape(h, 3 * w)
    return body.tobytes()


def read_stored(f, found: Layout, first: int, last: int) -> np.ndarray:
    """Stored frames first to last of one even stretch, a row each, from an open file."""
    held = f.read_at((last - first - 1) * found.step + found.size, found.place(first))
    rows = np.zeros((last - first, found.step), np.uint8)  # the last one's pad and the next head aren't read
    rows.reshape(-1)[: len(held)] = np.frombuffer(held, np.uint8)
    return rows[:, : found.size]


def decode_rows(rows: np.ndarray, h: int, w: int) -> np.ndarray:
    """RGB values of stored frames, a row each: rows bottom-up (top-down for a negative height), blue first, padded."""
    lines = rows.reshape(len(rows), abs(h), -1)[:, :, : w * 3].reshape(len(rows), abs(h), w, 3)
    return (lines[:, ::-1] if h > 0 else lines)[..., ::-1].reshape(len(rows), -1)


def write(out, frames: Iterable[bytes], n: int, h: int, w: int, fps: float, riff_bytes: int | None = None) -> None:
    """n stored frames into a stream that is only appended to, each by itself or some of them end to end."""
    size = h * ((w * 3 + 3) // 4 * 4)
    step = 8 + size + size % 2
    per = max(1, (riff_bytes or RIFF_BYTES) // step)
    counts = [min(per, n - k) for k in range(0, n, per)] or [0]
    index = lambda k: 32 + 8 * k  # an index chunk with its head
    long = len(counts) > 1

    def head(places: list[int]) -> bytes:
        avih = struct.pack("<14I", round(1e6 / fps), min(size * round(fps), (1 << 32) - 1), 0, 0x10, counts[0], 0, 1, size, w, h, 0, 0, 0, 0)
        strh = b"vids" + b"DIB " + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1000, round(fps * 1000), 0, n, size, 0, 0, 0, 0, w, h)
        strf = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 0, 0, 0, 0)
        strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)
        hdrl = b"hdrl" + chunk(b"avih", avih)
        if long:
            entries = b"".join(struct.pack("<QII", at, index(k), k) for at, k in zip(places, counts, strict=True))
            strl += chunk(b"indx", struct.pack("<HBBI4sIII", 4, 0, 0, len(counts), _FRAME, 0, 0, 0) + entries)
            return hdrl + chunk(b"LIST", strl) + chunk(b"LIST", b"odml" + chunk(b"dmlh", struct.pack("<I", n)))
        return hdrl + chunk(b"LIST", strl)

    before = [12 + len(chunk(b"LIST", head([0] * len(counts)))), *[12] * (len(counts) - 1)]
    movi = [4 + k * step + (index(k) if long else 0) for k in counts]
    begins, at = [], 0
    for b, m in zip(before, movi, strict=True):
        begins.append(at)
        at += b + 8 + m
    places = [begin + b + 12 + k * step for begin, b, k in zip(begins, before, counts, strict=True)]
    rest, held = iter(frames), np.zeros((0, size), np.uint8)
    for j, (k, b, m) in enumerate(zip(counts, before, movi, strict=True)):
        out.write(b"RIFF" + struct.pack("<I", b - 8 + 8 + m) + (b"AVIX" if j else b"AVI ") + (b"" if j else chunk(b"LIST", head(places))))
        out.write(b"LIST" + struct.pack("<I", m) + b"movi")
        left = k
        while left:
            if not len(held):
                body = next(rest)
                if not len(body) or len(body) % size:
                    raise ValueError("frames of one clip differ in size")
                held = np.frombuffer(body, np.uint8).reshape(-1, size)
            now, held = held[:left], held[left:]
            chunks = np.zeros((len(now), step), np.uint8)
            chunks[:, :8] = np.frombuffer(_FRAME + struct.pack("<I", size), np.uint8)
            chunks[:, 8 : 8 + size] = now
            out.write(chunks.data)
            left -= len(now)
        if long:
            base = begins[j] + b + 12
            entries = np.stack([np.arange(k) * step + 8, np.full(k, size)], 1).astype("<u4").tobytes()
            out.write(chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, k, _FRAME, base, 0) + entries))


def layout(f, size: int) -> Layout:
    """The layout of an open file of `size` bytes: the heads of lists are read, and of frames those that a
    search for the end of an even stretch needs.  Cut-off and empty frames aren't counted."""
    shape, fps, starts, frames = None, 0.0, [], 0

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    def video(at: int, end: int) -> None:
        """A movi list: chunks of one size, perhaps with others between them."""
        nonlocal frames
        h, w = shape
        body = abs(h) * ((w * 3 + 3) // 4 * 4)
        step = 8 + body + body % 2
        whole = lambda place: struct.unpack("<4sI", read(place, 8)) in ((_FRAME, body), (b"00dc", body))
        while at + 8 <= end:
            tag, n = struct.unpack("<4sI", read(at, 8))
            if tag not in (_FRAME, b"00dc") or n == 0:
                at += 8 + n + n % 2
                continue
            if n != body:
                raise ValueError("frames of one clip differ in size")
            low, high = 1, (end - at + body % 2) // step
            if not high:
                return
            while low < high:  # as many as follow evenly
                mid = (low + high + 1) // 2
                low, high = (mid, high) if whole(at + (mid - 1) * step) else (low, mid - 1)
            starts.append((frames, at + 8))
            frames += low
            at += low * step

    def walk(at: int, end: int) -> None:
        nonlocal shape, fps
        while at + 8 <= end:
            tag, n = struct.unpack("<4sI", read(at, 8))
            if tag in (b"RIFF", b"LIST"):
                kind = read(at + 8, 4)
                (video if kind == b"movi" and shape else walk)(at + 12, min(end, at + 8 + n) if n else end)
            elif tag == b"strh":
                kind, _, _, _, _, _, scale, rate = struct.unpack("<4s4sIHHIII", read(at + 8, 28))
                fps = rate / scale if kind == b"vids" and scale else fps
            elif tag == b"strf" and shape is None:
                _, w, h, _, bits, codec = struct.unpack("<IiiHHI", read(at + 8, 20))
                if bits != 24 or codec != 0:
                    raise ValueError("only uncompressed 24-bit AVI is read")
                shape = h, w
            at += 8 + n + n % 2

    walk(0, size)
    if shape is None or not frames:
        raise ValueError("no frames")
    return Layout(*shape, fps, frames, tuple(starts))
