"""Kernels on small grids, in NumPy behind pandas UDFs: the operations on arrays that column functions don't have.

A row is a grid in row-major order whose side is the root of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _grids(values: pd.Series) -> list[np.ndarray | None]:
    out = []
    for v in values:
        side = int(np.sqrt(len(v))) if v is not None else 0
        out.append(np.asarray(v, float)[: side * side].reshape(side, side) if side else None)
    return out


@F.pandas_udf(T.DoubleType())
def boundary_loss(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The mean binary cross-entropy of logits against a target (cells above 0), by the target's boundary weights."""
    from .leaves import boundary_weight

    for logits, targets in columns:
        out = []
        for x, t in zip(_grids(logits), _grids(targets), strict=True):
            fits = x is not None and t is not None and x.shape == t.shape
            out.append(float((boundary_weight(t > 0) * (np.maximum(x, 0) - x * (t > 0) + np.log1p(np.exp(-np.abs(x))))).mean()) if fits else None)
        yield pd.Series(out, dtype="float64")


def directed_wave(theta: float, length: float, width: float, side: int = 21) -> np.ndarray:
    """A Gabor kernel: a cosine of the given length along theta under a bell twice as long across as along."""
    y, x = np.mgrid[-(side // 2) : side // 2 + 1, -(side // 2) : side // 2 + 1].astype(float)
    along, across = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
    return np.exp(-(along**2 + 0.25 * across**2) / (2 * width**2)) * np.cos(2 * np.pi * along / length)


def filtered(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of each cell's surroundings weighted by a kernel of odd side that is the same from both ends, mirrored at borders."""
    r = kernel.shape[0] // 2
    padded = np.pad(np.asarray(grid, float), r, mode="reflect")
    product = np.fft.rfft2(padded) * np.fft.rfft2(kernel, padded.shape)
    return np.fft.irfft2(product, padded.shape)[2 * r :, 2 * r :]


def turning_patterns(grid: np.ndarray, points: int = 24, radius: float = 3) -> np.ndarray:
    """Each cell's uniform local pattern: how many of the points on a circle are no darker, or points + 1 if that turns over twice.

    Points between cells are interpolated; cells outside the grid are 0.
    """
    r = int(np.ceil(radius)) + 1
    padded = np.pad(np.asarray(grid, float), r)
    h, w = grid.shape
    ring = []
    for k in range(points):
        dy, dx = (round(v, 5) for v in (-radius * np.sin(2 * np.pi * k / points), radius * np.cos(2 * np.pi * k / points)))
        iy, ix = int(np.floor(dy)), int(np.floor(dx))
        part = lambda y, x: padded[r + y : r + y + h, r + x : r + x + w]  # noqa: B023, E731
        upper = part(iy, ix) * (1 - dx + ix) + part(iy, ix + 1) * (dx - ix)
        lower = part(iy + 1, ix) * (1 - dx + ix) + part(iy + 1, ix + 1) * (dx - ix)
        ring.append(upper * (1 - dy + iy) + lower * (dy - iy) >= grid - 1e-9)
    around = np.stack(ring)
    turns = (around != np.roll(around, 1, axis=0)).sum(axis=0)
    return np.where(turns <= 2, around.sum(axis=0), points + 1)


def texture_vector(grid: np.ndarray) -> list[float]:
    """Mean and deviation of 16 directed waves (four frequencies, four directions), then the shares of 26 local patterns."""
    out: list[float] = []
    for frequency in (0.1, 0.2, 0.3, 0.4):
        for quarter in range(4):
            answer = filtered(grid, directed_wave(quarter * np.pi / 4, 1 / frequency, 4.0))
            out += [answer.mean(), answer.std()]
    return [*out, *(np.bincount(turning_patterns(grid).ravel(), minlength=26) / grid.size)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def texture_features(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """58 numbers for each grid: see ``texture_vector``."""
    for batch in values:
        yield pd.Series([None if g is None else np.round(texture_vector(g), 6).tolist() for g in _grids(batch)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def silhouette(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A probability grid cut at 0.35, closed and then opened by an ellipse of 5 cells."""
    from .leaves import silhouette_of

    for batch in values:
        yield pd.Series([None if g is None else silhouette_of(g).astype(float).ravel().tolist() for g in _grids(batch)], dtype=object)


def edge_distance(mask: np.ndarray) -> np.ndarray:
    """Each cell's distance to the nearest cell of the other kind, infinite if there is none: down columns first, then along rows."""
    h, w = mask.shape
    out = np.full(mask.shape, np.inf)
    for kind in (False, True):
        down = np.where(mask == kind, 0.0, np.inf)
        for y in range(1, h):
            down[y] = np.minimum(down[y], down[y - 1] + 1)
        for y in range(h - 2, -1, -1):
            down[y] = np.minimum(down[y], down[y + 1] + 1)
        best = np.full(mask.shape, np.inf)
        for x in range(w):
            best = np.minimum(best, down[:, x : x + 1] ** 2 + (np.arange(w) - x) ** 2)
        out = np.where(mask == kind, out, np.sqrt(best))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def edge_distance_weight(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The boundary weights of the cells above 0: see ``leaves.boundary_weight``."""
    from .leaves import boundary_weight

    for batch in values:
        yield pd.Series([None if g is None else np.round(boundary_weight(g > 0), 6).ravel().tolist() for g in _grids(batch)], dtype=object)


MODES = T.ArrayType(T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("silhouette", T.ArrayType(T.DoubleType())),
    T.StructField("symptom", T.ArrayType(T.DoubleType())),
]))


#: Images whose pseudo-labels a worker holds at once: some 260 kB each for 1,024 cells.
IMAGES = 64


@F.arrow_udf(MODES)
def four_modes(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Red, green, blue (levels 0 to 255), leaf probability and category to the four pseudo-labels of ``leaves.fan_out``.

    Null if a grid is null, empty or not as large as the others, or the category isn't known. A batch goes through a few
    images at a time, since a worker's batches have as many rows whatever the size of an image.
    """
    from .leaves import SYMPTOMS, fan_out

    kind = to_arrow_type(MODES)
    for whole in columns:
        for at in range(0, len(whole[0]), IMAGES):
            *channels, categories = (c.slice(at, IMAGES).to_pandas() for c in whole)
            out = []
            for *grids, category in zip(*map(_grids, channels), categories, strict=True):
                fits = category in SYMPTOMS and all(g is not None and g.shape == grids[0].shape for g in grids)
                out.append(fan_out(np.clip(np.round(np.stack(grids[:3], -1)), 0, 255), grids[3], category) if fits else None)
            yield pa.array(out, kind)
