"""Recursive filters of any order along series of any length, in blocks of time.

A filter is a bank of cascades of second-order sections whose outputs are summed by weight.  Its state is a
vector, and a block of m frames maps the state before it to the state behind it: s -> A^m s + z, where z is
the state that the block reaches from zero.  Such maps compose, so the states before all blocks are a prefix
scan: maps are folded RADIX at a time, level by level, the highest level is run through from the clip's
first value, and the states go back down level by level.  Each level is a set of groups of RADIX short
rows, so the number of tasks grows with the blocks of a single series, and so does the depth with its
logarithm only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coeffs
from ..shared import kept
from ..timing import StageTimers
from . import clips
from .spectral import Finish
from .tiles import SERIES, ordered, own_values, series_rows

#: Frames in a block; blocks that are folded into one map.
BLOCK, RADIX = 1024, 128

#: (b0, b1, b2, a1, a2, how many times its first input a section's first output is).
Section = tuple[float, float, float, float, float, float]
#: Cascades with their weights.
Bank = tuple[tuple[tuple[Section, ...], float], ...]

_MAPS = "video_id string, level int, tile int, block int, frames long, fps double, first array<double>, state array<double>"
_STATES = "video_id string, level int, tile int, block int, begins boolean, state array<double>"
KEY = ["video_id", "level", "tile"]


def run(x: np.ndarray, sections: tuple[Section, ...], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, state behind) of rows of x after a state of two rows a section."""
    behind = np.empty_like(state)
    for i, (b0, b1, b2, a1, a2, _) in enumerate(sections):
        one, two = state[2 * i], state[2 * i + 1]
        y = b0 * x
        y[1:] += b1 * x[:-1]
        y[0] += one
        if b2 or a2 or two.any():
            y[2:] += b2 * x[:-2]
            if len(y) > 1:
                y[1] += two - a1 * y[0]
            for t in range(2, len(y)):
                y[t] -= a1 * y[t - 1] + a2 * y[t - 2]
            late = b2 * x[-2] - a2 * y[-2] if len(y) > 1 else two
        else:
            for t in range(1, len(y)):
                y[t] -= a1 * y[t - 1]
            late = 0.0
        behind[2 * i], behind[2 * i + 1] = b1 * x[-1] - a1 * y[-1] + late, b2 * x[-1] - a2 * y[-1]
        x = y
    return x, behind


def states(bank: Bank) -> int:
    return sum(2 * len(sections) for sections, _ in bank)


@cache
def _turns(bank: Bank) -> tuple[np.ndarray, np.ndarray]:
    """(A, state before the first frame for a first value of 1)."""
    size = states(bank)
    turn, start, at = np.zeros((size, size)), np.zeros(size), 0
    for sections, _ in bank:
        own = slice(at, at + 2 * len(sections))
        turn[own, own] = run(np.zeros((1, 2 * len(sections))), sections, np.eye(2 * len(sections)))[1]
        u = 1.0
        for i, (b0, _, b2, _, a2, first) in enumerate(sections):
            y = first * u
            start[at + 2 * i], start[at + 2 * i + 1] = y - b0 * u, b2 * u - a2 * y
            u = y
        at = own.stop
    return turn, start


@cache
def _power(bank: Bank, m: int) -> np.ndarray:
    return np.linalg.matrix_power(_turns(bank)[0], m)


def apply(x: np.ndarray, bank: Bank, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(weighted outputs, state behind) of rows of x; without a state they begin a clip."""
    if state is None:
        state = np.outer(_turns(bank)[1], x[0])
    total, behind, at = np.zeros_like(x), [], 0
    for sections, weight in bank:
        y, end = run(x, sections, state[at : at + 2 * len(sections)])
        total += weight * y
        behind.append(end)
        at += 2 * len(sections)
    return total, np.concatenate(behind)


def recursive(series: DataFrame, design: Callable[[float], Bank], fps: float | None = None, first_frame: str = "filter", finish: Finish | None = None, levels: int = 0, timers: StageTimers | None = None) -> DataFrame:
    """Every series of rows (video_id, level, tile, t, data[, fps, gain]) through the bank that `design`
    makes for its rate.  first_frame: what comes out at a clip's first frame, raw, zero, or as filtered.

    levels: how often maps are folded RADIX at a time before one group holds a series' maps; levels_of says how
    many keep that group at RADIX of them.  The rows are read twice, for the blocks' maps and for the result;
    with levels the maps, short rows, are written to the shared folder, so that it stays at that."""
    start, span, radix = first_frame, BLOCK, RADIX
    series = clips.rated(series, fps)
    blocks = series.withColumn("block", F.floor(F.col("t") / span).cast("int"))

    def rows(own: dict, block: list[int], **columns) -> pa.Table:
        same = {"video_id": pa.array([own["video_id"]] * len(block), pa.string())} | {c: pa.array([own[c]] * len(block), pa.int32()) for c in ("level", "tile")}
        return pa.table(same | {"block": pa.array(block, pa.int32())} | columns)

    def vectors(values: list[np.ndarray]) -> pa.Array:
        return pa.array([None if v is None else np.ravel(v) for v in values], pa.list_(pa.float64()))

    def maps(own: dict, block: int, frames: int, first: np.ndarray, state: np.ndarray) -> pa.Table:
        return rows(own, [block], frames=pa.array([frames], pa.int64()), fps=pa.array([own["fps"]]), first=vectors([first]), state=vectors([state]))

    def ends(table: pa.Table) -> pa.Table:
        own = own_values(table)
        bank = design(own["fps"])
        _, x = ordered(table)
        return maps(own, own["block"], len(x), x[0], apply(x, bank, np.zeros((states(bank), x.shape[1])))[1])

    def steps(table: pa.Table):
        """(bank, rows in order of blocks: (block, frames, first value, z))."""
        table = table.sort_by("block").combine_chunks()
        bank = design(table["fps"][0].as_py())
        first, state = table["first"].combine_chunks(), table["state"].combine_chunks()
        return bank, [(b, m, f.values.to_numpy(), z.values.to_numpy().reshape(states(bank), -1)) for b, m, f, z in zip(table["block"].to_pylist(), table["frames"].to_pylist(), first, state, strict=True)]

    def fold(table: pa.Table) -> pa.Table:
        bank, parts = steps(table)
        block, frames, first, z = parts[0]
        for _, m, _, more in parts[1:]:
            frames, z = frames + m, _power(bank, m) @ z + more
        return maps(own_values(table), block // radix, frames, first, z)

    def unfold(table: pa.Table, above: pa.Table | None = None) -> pa.Table:
        bank, parts = steps(table)
        begins, state = (True, np.outer(_turns(bank)[1], parts[0][2])) if above is None else (above["begins"][0].as_py(), above["state"].combine_chunks()[0].values.to_numpy().reshape(states(bank), -1))
        given = []
        for _, m, _, z in parts:
            given.append(state)
            state = _power(bank, m) @ state + z
        return rows(own_values(table), [p[0] for p in parts], begins=pa.array([begins, *[False] * (len(parts) - 1)]), state=vectors(given))

    def work(table: pa.Table, before: pa.Table) -> pa.Table:
        own = own_values(table)
        bank = design(own["fps"])
        t, x = ordered(table)
        begins = before["begins"][0].as_py()
        y, _ = apply(x, bank, before["state"].combine_chunks()[0].values.to_numpy().reshape(states(bank), -1))
        if begins and start != "filter":
            y[0] = x[0] if start == "raw" else 0.0
        return series_rows(table, t, finish(y, own, begins) if finish else y)

    timed = timers.groups("filter", work) if timers else work
    tower = [blocks.groupBy(*KEY, "block").applyInArrow(timers.groups("filter, ends of blocks", ends) if timers else ends, _MAPS)]
    if levels:
        tower = [kept(series.sparkSession, tower[0], "maps")]
    for _ in range(levels):
        tower.append(tower[-1].groupBy(*KEY, F.floor(F.col("block") / radix).alias("above")).applyInArrow(fold, _MAPS))
    found = tower.pop().groupBy(*KEY).applyInArrow(lambda table: unfold(table), _STATES)
    while tower:
        found = tower.pop().groupBy(*KEY, F.floor(F.col("block") / radix).cast("int").alias("above")).cogroup(found.groupBy(*KEY, "block")).applyInArrow(unfold, _STATES)
    return blocks.groupBy(*KEY, "block").cogroup(found.groupBy(*KEY, "block")).applyInArrow(timed, SERIES)


def levels_of(frames: DataFrame) -> int:
    """How many levels the longest clip of rows (video_id, t) needs.  Reads t only."""
    longest = frames.groupBy("video_id").agg((F.max("t") - F.min("t")).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks, levels = longest // BLOCK + 1, 0
    while blocks > RADIX:
        blocks, levels = -(-blocks // RADIX), levels + 1
    return levels


def low_pass_pair(low: float, high: float, kind: str = "butterworth") -> Callable[[float], Bank]:
    """The difference of two order-1 low-passes."""
    return lambda fps: ((coeffs.first_order_section(high, fps, kind), 1.0), (coeffs.first_order_section(low, fps, kind), -1.0))


def iir_lowpass(series: DataFrame, fps: float | None, cutoff: float, kind: str = "butterworth", levels: int = 0) -> DataFrame:
    return recursive(series, lambda rate: ((coeffs.first_order_section(cutoff, rate, kind), 1.0),), fps, "filter", None, levels)


def iir_bandpass(series: DataFrame, fps: float | None, low: float, high: float, first_frame: str = "raw", kind: str = "butterworth", finish: Finish | None = None, levels: int = 0, timers: StageTimers | None = None) -> DataFrame:
    """The difference of two order-1 low-passes that start at the first frame."""
    return recursive(series, low_pass_pair(low, high, kind), fps, first_frame, finish, levels, timers)


def butterworth(series: DataFrame, fps: float | None, order: int, low: float | None, high: float | None, levels: int = 0) -> DataFrame:
    """A Butterworth filter of any order: a low-pass under `high`, a high-pass over `low`, or with both a
    band of twice the order, one after the other.  It starts as if the first value had always been there."""

    def design(rate: float) -> Bank:
        parts = [coeffs.sections(order, hz, kind, rate) for hz, kind in ((low, "high"), (high, "low")) if hz is not None]
        return ((tuple(s for p in parts for s in p), 1.0),)

    return recursive(series, design, fps, "filter", None, levels)


def recursive_bandpass(x: np.ndarray, fps: float, low: float, high: float, first_frame: str = "raw", kind: str = "butterworth") -> np.ndarray:
    """The band-pass of iir_bandpass over rows of one array that begins with a clip."""
    if not len(x):
        return np.empty_like(x)
    out, _ = apply(x, low_pass_pair(low, high, kind)(fps), None)
    out[0] = x[0] if first_frame == "raw" else 0.0
    return out
