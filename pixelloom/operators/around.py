"""Neighbourhoods of stacked images: what ``windows`` computes along lines of a pixel table,
as columns that ``whole.add`` adds in its one pass over whole images.

The results are those of ``windows``: kernels are cut off at the image's edge for masks, and
box sums and blurs mirror it without repeating it. Sums are of whole numbers, so exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from .whole import Added
from .windows import ellipse


def shifted(a: np.ndarray, dy: int, dx: int, outside) -> np.ndarray:
    """The values at (y + dy, x + dx); ``outside`` where that is none of the image."""
    out = np.full_like(a, outside)
    h, w = a.shape[1:]
    if abs(dy) < h and abs(dx) < w:
        out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    """True wherever an elliptical k x k kernel, centred there, meets a true pixel."""
    widths = ellipse(k)
    r, wide, along = len(widths) // 2, {}, mask.copy()
    for n in range(max(widths) + 1):  # masks grown along the lines, a pixel wider each time
        if n:
            along[:, :, n:] |= mask[:, :, :-n]
            along[:, :, :-n] |= mask[:, :, n:]
        if n in widths:
            wide[n] = along.copy()
    out = np.zeros_like(mask)
    for dy, n in zip(range(-r, r + 1), widths, strict=True):
        out |= shifted(wide[n], dy, 0, False)
    return out


def erode(mask: np.ndarray, k: int) -> np.ndarray:
    """True where all of the kernel inside the image is true."""
    return ~dilate(~mask, k)


def open_(mask: np.ndarray, k: int) -> np.ndarray:
    return dilate(erode(mask, k), k)


def close(mask: np.ndarray, k: int) -> np.ndarray:
    return erode(dilate(mask, k), k)


def _mask(f):
    return lambda col, k: Added(BooleanType(), lambda get: f(get(col), k))


dilated, eroded, opened, closed = _mask(dilate), _mask(erode), _mask(open_), _mask(close)


def _mirrored(a: np.ndarray, r: int) -> np.ndarray:
    return np.pad(a.astype(np.int64), ((0, 0), (r, r), (r, r)), mode="reflect")


def _boxes(mirrored: np.ndarray, n: int) -> np.ndarray:
    for axis in (1, 2):
        sums = np.insert(mirrored.cumsum(axis=axis), 0, 0, axis=axis)
        size = sums.shape[axis]
        mirrored = np.take(sums, range(n, size), axis=axis) - np.take(sums, range(size - n), axis=axis)
    return mirrored


def mean(col: str, n: int) -> Added:
    """Mean of whole numbers or a mask over n x n pixels with mirrored edges."""
    return Added(DoubleType(), lambda get: _boxes(_mirrored(get(col), n // 2), n) / float(n * n))


def deviation(col: str, n: int) -> Added:
    """Standard deviation of whole numbers over n x n pixels with mirrored edges."""

    def values(get):
        a = _mirrored(get(col), n // 2)
        m, m2 = _boxes(a, n) / float(n * n), _boxes(a * a, n) / float(n * n)
        return np.sqrt(np.maximum(m2 - m * m, 0.0))

    return Added(DoubleType(), values)


def blurred(col: str, n: int) -> Added:
    """Binomial blur of whole numbers by n x n pixels, rounded, mirrored edges."""
    kernel = [math.comb(n - 1, k) for k in range(n)]

    def values(get):
        a = _mirrored(get(col), n // 2)
        h, w = a.shape[1] - n + 1, a.shape[2] - n + 1
        a = sum(weight * a[:, :, k : k + w] for k, weight in enumerate(kernel))
        a = sum(weight * a[:, k : k + h] for k, weight in enumerate(kernel))
        return np.floor(a / float(sum(kernel) ** 2) + 0.5).astype(np.int32)

    return Added(IntegerType(), values)


def edge_grade(col: str, low: int, high: int) -> Added:
    """2 on strong Canny edges of whole numbers, 1 on weak ones, 0 elsewhere (``windows.edges``)."""

    def values(get):
        v = get(col).astype(np.int64)
        p = np.pad(v, ((0, 0), (0, 0), (1, 1)), mode="edge")
        dx, sx = p[:, :, 2:] - p[:, :, :-2], p[:, :, :-2] + 2 * v + p[:, :, 2:]
        dx, sx = (np.pad(a, ((0, 0), (1, 1), (0, 0)), mode="edge") for a in (dx, sx))
        gx, gy = dx[:, :-2] + 2 * dx[:, 1:-1] + dx[:, 2:], sx[:, 2:] - sx[:, :-2]
        ax, ay = np.abs(gx), np.abs(gy)
        m = ax + ay
        at = lambda dy, dx_: shifted(m, dy, dx_, 0)
        flat, steep, same = ay * 2.414213562373095 < ax, ay > ax * 2.414213562373095, gx * gy >= 0
        before = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
        after = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
        peak = (m > before) & (m >= after)
        return (peak & (m > low)).astype(np.int32) + (peak & (m > high))

    return Added(IntegerType(), values)


def graded(col: str, at_least: int) -> Added:
    return Added(BooleanType(), lambda get: get(col) >= at_least)
