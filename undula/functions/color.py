"""Colour and value-range projections as Column expressions (whole-stage codegen)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# RGB to YIQ, and one dialect's seven-digit inverse.
YIQ = ((0.299, 0.587, 0.114), (0.59590059, -0.27455667, -0.32134392), (0.21153661, -0.52273617, 0.31119955))
INVERSE_CONSTANTS = ((1.0, 0.9559863, 0.6208248), (1.0, -0.2720128, -0.6472042), (1.0, -1.1067402, 1.7042304))


def inverse(kind: str = "exact") -> tuple[tuple[float, ...], ...]:
    if kind == "constants":
        return INVERSE_CONSTANTS
    return tuple(map(tuple, np.linalg.inv(np.array(YIQ)).tolist()))


def dot(row: tuple[float, ...], columns: list[Column]) -> Column:
    return row[0] * columns[0] + row[1] * columns[1] + row[2] * columns[2]


def rgb_to_yiq(r: Column, g: Column, b: Column) -> list[Column]:
    return [dot(row, [r, g, b]) for row in YIQ]


def yiq_to_rgb(y: Column, i: Column, q: Column, kind: str = "exact") -> list[Column]:
    return [dot(row, [y, i, q]) for row in inverse(kind)]


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def to_u8(v: Column, rounding: str = "rint") -> Column:
    """0..255: saturating half-even rounding, or truncation."""
    v = clamp(v, 0.0, 255.0)
    return (F.rint(v) if rounding == "rint" else F.floor(v)).cast("int")


def scale_down(v: Column) -> Column:
    return v / 255.0


def scale_up(v: Column) -> Column:
    return v * 255.0


def swap_channels(ch: Column) -> Column:
    """BGR to RGB and back."""
    return 2 - ch


def flat_to_struct(data: Column) -> Column:
    """An interleaved array of a three-channel frame to an array of (r, g, b)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(data) / 3).cast("int") - 1), lambda i: F.struct(data[3 * i].alias("r"), data[3 * i + 1].alias("g"), data[3 * i + 2].alias("b")))


def struct_to_flat(data: Column) -> Column:
    return F.flatten(F.transform(data, lambda p: F.array(p["r"], p["g"], p["b"])))
