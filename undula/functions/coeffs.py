"""Scalars and small tables that plans carry as literals: filters, bins, gains, sizes."""

from __future__ import annotations

from math import hypot, pi, sin, tan

import numpy as np


def butterworth(order: int, cutoff: float, btype: str, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter by the pre-warped bilinear transform."""
    if order < 1 or fs <= 0 or not 0 < cutoff < fs / 2:
        raise ValueError("order >= 1 and 0 < cutoff < fs / 2 are needed")
    if btype not in ("low", "high"):
        raise ValueError(f"btype {btype!r}")
    warped = 2 * fs * tan(pi * cutoff / fs)
    poles = np.exp(1j * pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = warped * poles if btype == "low" else warped / poles
    z = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.full(order, -1.0 if btype == "low" else 1.0)))
    at = 1.0 if btype == "low" else -1.0  # unit gain at DC, or at half of fs
    b = b * np.polyval(a, at) / np.polyval(b, at)
    return b, a


def first_order(cutoff: float, fs: float, kind: str = "butterworth") -> tuple[float, float, float]:
    """(b0, b1, a1) of y = b0 x + b1 x' - a1 y'.  `halved` is the known off dialect: a1 = -(1 - k)."""
    b, a = butterworth(1, cutoff, "low", fs)
    if kind == "halved":
        return float(b[0]), float(b[1]), -(1.0 - float(b[0]))
    return float(b[0]), float(b[1]), float(a[1])


def first_order_section(cutoff: float, fs: float, kind: str = "butterworth") -> tuple[tuple[float, ...], ...]:
    """An order-1 low-pass as a cascade of one section, whose first output is its first input."""
    b0, b1, a1 = first_order(cutoff, fs, kind)
    return ((b0, b1, 0.0, a1, 0.0, 1.0),)


def sections(order: int, cutoff: float, btype: str, fs: float) -> tuple[tuple[float, ...], ...]:
    """A Butterworth filter of any order as second-order sections (b0, b1, b2, a1, a2, gain at rest), one for
    each pair of poles and an order-1 section where one pole is left."""
    if order < 1 or fs <= 0 or not 0 < cutoff < fs / 2:
        raise ValueError("order >= 1 and 0 < cutoff < fs / 2 are needed")
    if btype not in ("low", "high"):
        raise ValueError(f"btype {btype!r}")
    k, low = tan(pi * cutoff / fs), btype == "low"
    out = []
    for j in range(order // 2):
        damping = 2 * sin(pi * (2 * j + 1) / (2 * order))
        norm = 1 / (1 + damping * k + k * k)
        b = k * k * norm if low else norm
        out.append((b, 2 * b if low else -2 * b, b, 2 * (k * k - 1) * norm, (1 - damping * k + k * k) * norm, float(low)))
    if order % 2:
        b = k / (1 + k) if low else 1 / (1 + k)
        out.append((b, b if low else -b, 0.0, (k - 1) / (k + 1), 0.0, float(low)))
    return tuple(out)


def frequencies(n: int, fps: float) -> np.ndarray:
    """The frequency of every bin, negative ones in the upper half."""
    k = np.arange(n)
    return np.where(k < (n + 1) // 2, k, k - n) * fps / n


def nearest_bin(n: int, fps: float, hz: float) -> int:
    """The first bin nearest to hz."""
    return int(np.abs(frequencies(n, fps) - hz).argmin())


def kept_bins(n: int, fps: float, low: float, high: float, mask: str = "symmetric") -> list[tuple[int, float]]:
    """(bin, weight) so that y_t = 1/n * sum of weight * (a cos + b sin) over non-negative bins."""
    if mask == "onesided":
        return [(k, 1.0) for k in range(nearest_bin(n, fps, low), nearest_bin(n, fps, high))]
    f = np.abs(frequencies(n, fps))[: n // 2 + 1]
    return [(k, 1.0 if k == 0 or 2 * k == n else 2.0) for k in np.flatnonzero((low <= f) & (f <= high)).tolist()]


def smooth_length(n: int) -> int:
    """The least 2-3-5-smooth number from n on."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def half(n: int, rule: str = "ceil") -> int:
    return (n + 1) // 2 if rule == "ceil" else n // 2


def level_sizes(h: int, w: int, levels: int, rule: str = "ceil") -> list[tuple[int, int]]:
    """Sizes of level 0 and of each halving, at least 1."""
    out = [(h, w)]
    for _ in range(levels):
        h, w = max(1, half(h, rule)), max(1, half(w, rule))
        out.append((h, w))
    return out


def wavelength_gain(h: int, w: int, alpha: float, lambda_cutoff: float) -> float:
    """The gain of a band whose size bounds the spatial wavelength."""
    delta = lambda_cutoff / (8.0 * (1.0 + alpha))
    return min(alpha, hypot(h, w) / (8.0 * delta) - 1.0)


def level_gains(sizes: list[tuple[int, int]], alpha: float, lambda_cutoff: float) -> list[float]:
    """Gains of a pyramid's levels: only inner levels are amplified."""
    last = len(sizes) - 1
    return [wavelength_gain(h, w, alpha, lambda_cutoff) if 0 < i < last else 1.0 for i, (h, w) in enumerate(sizes)]
