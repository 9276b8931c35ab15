"""Image operators in NumPy behind pandas UDFs: perceptual hash, local contrast, masks' largest component, polygon filling.

A row is a grid in row-major order whose side is the root of its length, or a list of polygons.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pixels import _grids


def resized(grid: np.ndarray, side: int) -> np.ndarray:
    """Bilinear samples of a grid at the centres of side x side cells."""
    at = [np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1) for n in grid.shape]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(a + 1, n - 1) for a, n in zip(low, grid.shape, strict=True)]
    fy, fx = (at[0] - low[0])[:, None], at[1] - low[1]
    rows = grid[low[0]] * (1 - fy) + grid[high[0]] * fy
    return rows[:, low[1]] * (1 - fx) + rows[:, high[1]] * fx


def cosines(n: int) -> np.ndarray:
    """The matrix of the discrete cosine transform (its second kind, unscaled): a row for each frequency."""
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k + 1) / (2 * n))


def phash(grid: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """A hash of size x size signs: low frequencies of the shrunk grid above their median, the first one the highest bit."""
    c = cosines(size * factor)[:size]
    low = np.round(c @ resized(grid, size * factor) @ c.T, 9)
    code = 0
    for bit in (low > np.median(low)).ravel().tolist():
        code = code << 1 | bit
    return code - (1 << 64) if code >> 63 else code


def clahe(grid: np.ndarray, clip: float = 2.0, tiles: int | tuple[int, int] = 8, bins: int = 256) -> np.ndarray:
    """Equalises a grid of levels 0 to bins - 1 tile by tile, with clipped histograms, and blends the maps of the four nearest tiles."""
    level = np.clip(np.round(grid), 0, bins - 1).astype(int)
    tiles = (tiles, tiles) if isinstance(tiles, int) else tiles
    h, w = (-(-n // t) for n, t in zip(grid.shape, tiles, strict=True))
    padded = np.pad(level, [(0, h * tiles[0] - grid.shape[0]), (0, w * tiles[1] - grid.shape[1])], mode="symmetric")
    maps = np.empty((*tiles, bins))
    limit = max(1, int(clip * h * w / bins))
    for i in range(tiles[0]):
        for j in range(tiles[1]):
            counts = np.bincount(padded[i * h : (i + 1) * h, j * w : (j + 1) * w].ravel(), minlength=bins)
            over = int(np.maximum(counts - limit, 0).sum())
            maps[i, j] = np.cumsum(np.minimum(counts, limit) + over / bins) * (bins - 1) / (h * w)
    at = [np.clip((np.arange(n) + 0.5) / t - 0.5, 0, k - 1) for n, t, k in zip(grid.shape, (h, w), tiles, strict=True)]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(a + 1, k - 1) for a, k in zip(low, tiles, strict=True)]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    of = lambda y, x: maps[y[:, None], x[None, :], level]
    upper = of(low[0], low[1]) * (1 - fx) + of(low[0], high[1]) * fx
    lower = of(high[0], low[1]) * (1 - fx) + of(high[0], high[1]) * fx
    return np.clip(np.round(upper * (1 - fy) + lower * fy), 0, bins - 1)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest set of cells that hang together by any of eight neighbours; of equal ones the first in row-major order."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        around = np.pad(label, 1)
        best = np.lib.stride_tricks.sliding_window_view(around, (3, 3)).max(axis=(2, 3)) * (label > 0)
        if (best == label).all():
            break
        label = best
    ids, first, counts = np.unique(label[label > 0], return_index=True, return_counts=True)
    return label == ids[np.lexsort((first, -counts))[0]] if len(ids) else mask.astype(bool) & False


def filled(polygons: Sequence[Sequence[Sequence[float]]], height: int, width: int) -> np.ndarray:
    """Cells inside polygons given in percent of width and height, or on their edges; corners are cut to whole cells."""
    mask = np.zeros((height, width), bool)
    y, x = np.arange(height), np.arange(width)
    for polygon in polygons:
        points = [(int(px / 100 * width), int(py / 100 * height)) for px, py in polygon]
        inside = np.zeros_like(mask)
        for (ax, ay), (bx, by) in zip(points, [*points[1:], *points[:1]], strict=True):
            if ay != by:
                low, high = max(min(ay, by), 0), max(max(ay, by), 0)  # the rows the edge crosses
                inside[low:high] ^= x < ((bx - ax) * (y[low:high] - ay) / (by - ay) + ax)[:, None]
            steps = max(abs(bx - ax), abs(by - ay), 1)
            t = np.arange(steps + 1) / steps
            ex, ey = np.floor(ax + (bx - ax) * t + 0.5).astype(int), np.floor(ay + (by - ay) * t + 0.5).astype(int)
            on = (ex >= 0) & (ex < width) & (ey >= 0) & (ey < height)
            mask[ey[on], ex[on]] = True
        mask |= inside
    return mask


def _each(values: Iterator[pd.Series], use) -> Iterator[pd.Series]:
    for batch in values:
        yield pd.Series([None if g is None else use(g) for g in _grids(batch)], dtype=object)


def _levels(grid: np.ndarray) -> np.ndarray:
    """A grid as levels 0 to 255 between its extremes."""
    low, high = grid.min(), grid.max()
    return np.round((grid - low) / (high - low) * 255) if high > low else np.zeros_like(grid)


@F.pandas_udf(T.LongType())
def perceptual_hash(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _each(values, lambda g: phash(_levels(g)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def local_contrast(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _each(values, lambda g: clahe(_levels(g), tiles=2).ravel().tolist())


@F.pandas_udf(T.StructType([T.StructField("area", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def main_region(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Cells and centroid of the largest component above 0; null centroids for none."""
    for batch in values:
        rows = []
        for g in _grids(batch):
            cells = np.argwhere(largest_component(g > 0)) if g is not None else np.zeros((0, 2))
            rows.append((len(cells), *((float(cells[:, k].mean()) for k in (1, 0)) if len(cells) else (None, None))))
        yield pd.DataFrame(rows, columns=["area", "x", "y"])


@F.pandas_udf(T.LongType())
def polygon_cells(polygons: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Cells of a 64 x 64 grid that polygons in percent fill."""
    for batch in polygons:
        yield pd.Series([None if p is None else int(filled([[tuple(q) for q in poly] for poly in p], 64, 64).sum()) for p in batch], dtype=object)
