"""One-dimensional linear maps behind every spatial operator.

Blur, down- and up-sampling are separable and linear, so along an axis each is a sparse matrix, given
as taps: out[o] = sum over k of weight[o, k] * in[index[o, k]].  Chains of them are products, which is
how a whole Gaussian pyramid becomes one pass per axis.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

KERNEL = np.array([1, 4, 6, 4, 1]) / 16.0


def mirror(i: np.ndarray, n: int, border: str = "reflect101") -> np.ndarray:
    """Indices folded into 0..n-1.  reflect101: -1 is 1; reflect: -1 is 0.  A size of 1 folds to 0."""
    if n == 1:
        return np.zeros_like(i)
    if border == "reflect101":
        i = np.abs(i) % (2 * (n - 1))
        return np.where(i >= n, 2 * (n - 1) - i, i)
    i = np.where(i < 0, -i - 1, i) % (2 * n)
    return np.where(i >= n, 2 * n - 1 - i, i)


def blur(n: int, border: str = "reflect101") -> np.ndarray:
    """The n x n matrix of the five-tap kernel."""
    return down(n, n, 1, border)


def down(n: int, size: int, step: int = 2, border: str = "reflect101") -> np.ndarray:
    """size x n: the blurred value of every step-th place."""
    out = np.zeros((size, n))
    o = np.arange(size)
    for d, k in zip(range(-2, 3), KERNEL, strict=True):
        np.add.at(out, (o, mirror(step * o + d, n, border)), k)
    return out


def up(n: int, size: int, border: str = "reflect101") -> np.ndarray:
    """size x n: zeros between the places, then twice the kernel (four times over both axes)."""
    out = np.zeros((size, n))
    o = np.arange(size)
    for d, k in zip(range(-2, 3), KERNEL, strict=True):
        j = mirror(o + d, size, border)
        even = (j % 2 == 0) & (j // 2 < n)
        np.add.at(out, (o[even], j[even] // 2), 2 * k)
    return out


def up_size(n: int, target: int | None = None) -> int:
    """2n, or 2n - 1 where the size to reach isn't a multiple of n."""
    return 2 * n if target is None or target % n == 0 else 2 * n - 1


def bilinear(n: int, size: int) -> np.ndarray:
    """size x n: half-pixel-centred linear interpolation, for shape repair."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = np.zeros((size, n))
    np.add.at(out, (np.arange(size), low), 1 - (at - low))
    np.add.at(out, (np.arange(size), np.minimum(low + 1, n - 1)), at - low)
    return out


def window(n: int, size: int = 11, sigma: float = 1.5, border: str = "reflect101") -> np.ndarray:
    """n x n: means under a Gaussian window of `size` places around each one."""
    out, reach = np.zeros((n, n)), size // 2
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for d, k in zip(range(-reach, reach + 1), weight / weight.sum(), strict=True):
        np.add.at(out, (np.arange(n), mirror(np.arange(n) + d, n, border)), k)
    return out


def gaussian(n: int, levels: int, border: str = "reflect101", rule: str = "ceil") -> np.ndarray:
    """n x n: `levels` times down and up again to the recorded sizes, as one matrix."""
    sizes = [n]
    for _ in range(levels):
        sizes.append(max(1, (sizes[-1] + 1) // 2 if rule == "ceil" else sizes[-1] // 2))
    out = np.eye(n)
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out = down(a, b, 2, border) @ out
    for b, a in zip(sizes[:0:-1], sizes[-2::-1], strict=True):
        out = up(b, a, border) @ out
    return out


def entries(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    """(out, in, weight) of what isn't zero."""
    o, i = np.nonzero(matrix)
    return [(int(a), int(b), float(matrix[a, b])) for a, b in zip(o, i, strict=True)]


#: (index, weight) of each output's inputs, a column a tap.
Taps = tuple[np.ndarray, np.ndarray]


def taps(matrix: np.ndarray) -> Taps:
    width = int((matrix != 0).sum(1).max()) if matrix.size else 0
    index = np.argsort(matrix == 0, axis=1, kind="stable")[:, :width]
    return index, np.take_along_axis(matrix, index, 1)


@lru_cache(256)
def down_taps(n: int, size: int, border: str = "reflect101") -> Taps:
    """Of `down`, kept for the next frame of that size."""
    return taps(down(n, size, 2, border))


@lru_cache(256)
def up_taps(n: int, size: int, border: str = "reflect101") -> Taps:
    return taps(up(n, size, border))


def tapped(x: np.ndarray, given: Taps, axis: int) -> np.ndarray:
    """Shifted sums along one axis, in order of taps."""
    index, weight = given
    shape = [1] * x.ndim
    shape[axis] = -1
    out = np.zeros((*x.shape[:axis], len(index), *x.shape[axis + 1 :]))
    for k in range(index.shape[1]):
        part = np.take(x, index[:, k], axis)
        part *= weight[:, k].reshape(shape)
        out += part
    return out


def along(x: np.ndarray, matrix: np.ndarray, axis: int) -> np.ndarray:
    """The matrix applied along one axis; narrow matrices as shifted sums of taps."""
    if matrix.size and (matrix != 0).sum(1).max() > 12:
        return np.moveaxis(np.tensordot(matrix, np.moveaxis(x, axis, 0), (1, 0)), 0, axis)
    return tapped(x, taps(matrix), axis)
