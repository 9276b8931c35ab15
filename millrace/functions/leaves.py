"""Leaf images in NumPy: colours, textures, ridges, directed openings, margins, and the symptom masks made of them.

Images are arrays of height x width (x 3), masks are boolean. Each function takes any size, from one cell on. What depends
on the image alone (colours, texture, ridges) is computed once and shared by the four modes of ``fan_out``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..operators.brackets import COVERAGE_WEIGHTS, SEVERITY_GRADES
from .imaging import clahe, largest_component
from .pixels import directed_wave, edge_distance, filtered

# Levels are 0 to 255 with 128 as neutral, angles degrees, scales and lengths cells.
GREENER_IS_HEALTHY = 121
OPENING_ANGLES = [0, 30, 60, 90, 120, 150]
OPENING_SHORT, OPENING_LONG, OPENING_LONG_FROM = 7, 15, 0.08
RIDGE_SCALES = [0.5, 1.5, 3.0, 6.0, 10.0]
WAVE_ANGLES, WAVE_LENGTH, WAVE_WIDTH, WAVE_RED_SHARE = [0, 45, 90, 135], 10.0, 4.0, 0.4
TEXTURE_SOFT, TEXTURE_HARD = 0.3, 0.4
MARGIN_SHARE = 0.08
SILHOUETTE_FROM, SILHOUETTE_SHAPE = 0.35, 5
STRETCH_UP_TO = 180
HEALTHY_ZERO, HEALTHY_DAMPED, HEALTHY_CEILING, HEALTHY_FACTOR = 0.01, 0.04, 0.15, 0.3


@dataclass(frozen=True)
class Symptom:
    """A category's least red and yellow levels, how far the image may raise them, and the vein weight that a cell needs."""

    red: int
    yellow: int
    red_most: int
    yellow_most: int
    vein_weight: float


# Fixed values.
SYMPTOMS = {
    "MSV": Symptom(133, 135, 148, 150, 0.5),
    "MLN": Symptom(130, 138, 146, 150, 0.35),
    "HEALTHY": Symptom(140, 145, 140, 145, 0.6),
}


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (sRGB, D65) in whole levels: L* over 0 to 255, a* and b* about 128."""
    c = np.asarray(rgb, float) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    x, y, z = np.moveaxis(linear @ to_xyz.T / to_xyz.sum(axis=1), -1, 0)
    root = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    parts = [(116 * root(y) - 16) * 255 / 100, 500 * (root(x) - root(y)) + 128, 200 * (root(y) - root(z)) + 128]
    return np.clip(np.round(np.stack(parts, -1)), 0, 255).astype(int)


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(rgb, float) @ [0.299, 0.587, 0.114]).astype(int)


def stretched(level: np.ndarray) -> np.ndarray:
    """Levels spread over 0 to 255, but for images that are flat or span over 180 levels already."""
    low, span = level.min(), np.ptp(level)
    return (level - low) * 255 // span if 0 < span <= STRETCH_UP_TO else level


def within(level: np.ndarray, leaf: np.ndarray, clip: float) -> np.ndarray:
    """Local contrast for the cells of a leaf of 100 cells or more; other cells stay."""
    if leaf.sum() < 100:
        return level
    tiles = tuple(max(4, n // 56 // 2 * 2) for n in level.shape)
    return np.where(leaf, clahe(level, clip, tiles).astype(int), level)


def ellipse(side: int) -> np.ndarray:
    """The cells of an ellipse in a square of odd side."""
    r = side // 2
    reach = np.round(r * np.sqrt(1 - (np.arange(-r, r + 1) / max(r, 1)) ** 2))
    return np.abs(np.arange(-r, r + 1)) <= reach[:, None]


def line(length: int, angle: float) -> np.ndarray:
    """The cells nearest to a line through the middle of a square of odd side, alike from both ends."""
    r = length // 2
    t = np.arange(r + 1)
    dy, dx = (np.floor(t * round(abs(f(np.deg2rad(angle))), 9) + 0.5).astype(int) for f in (np.sin, np.cos))
    turn = -1 if angle % 180 < 90 else 1
    shape = np.zeros((length, length), bool)
    shape[r + turn * dy, r + dx] = shape[r - turn * dy, r - dx] = True
    return shape


def _swept(mask: np.ndarray, shape: np.ndarray, every: bool) -> np.ndarray:
    ry, rx = (n // 2 for n in shape.shape)
    padded = np.pad(mask, ((ry, ry), (rx, rx)), constant_values=every)
    out = np.full(mask.shape, every)
    for dy, dx in np.argwhere(shape):
        seen = padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
        out = out & seen if every else out | seen
    return out


def eroded(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Cells about which the whole shape lies in the mask; what is outside the image counts as in it."""
    return _swept(mask, shape, True)


def dilated(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Cells about which any of the shape lies in the mask; what is outside the image doesn't."""
    return _swept(mask, shape, False)


def opened(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return dilated(eroded(mask, shape), shape)


def closed(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return eroded(dilated(mask, shape), shape)


def silhouette_of(prob: np.ndarray) -> np.ndarray:
    """Probabilities cut at 0.35, closed, then opened, by an ellipse of 5 cells."""
    shape = ellipse(SILHOUETTE_SHAPE)
    return opened(closed(prob >= SILHOUETTE_FROM, shape), shape)


def streaks(mask: np.ndarray, category: str, share: float) -> np.ndarray:
    """The mask opened by short lines, beside long ones where symptoms cover over 8 % of the leaf.

    Streaks keep what a line at any of six angles fits; blots are closed first and, like healthy leaves, opened upright only.
    """
    if category == "MLN":
        mask = closed(mask, ellipse(5))
    out = np.zeros_like(mask)
    for length in [OPENING_SHORT, OPENING_LONG] if share > OPENING_LONG_FROM else [OPENING_SHORT]:
        for angle in OPENING_ANGLES if category == "MSV" else [90]:
            out |= opened(mask, line(length, angle))
    return out


def hull(cells: np.ndarray) -> list[tuple[int, int]]:
    """The corners of the convex hull of cells (rows of y, x), in turn."""
    points = sorted(map(tuple, cells.tolist()))
    sides = []
    for ordered in (points, points[::-1]):
        side: list[tuple[int, int]] = []
        for p in ordered:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1] or side
    return sides


def interior(leaf: np.ndarray) -> np.ndarray:
    """The convex hull of the leaf's largest component less a margin of 8 % of the root of the leaf's area, at least a cell."""
    cells = np.argwhere(largest_component(leaf))
    if not len(cells):
        return leaf
    corners = hull(cells)
    y, x = np.ogrid[: leaf.shape[0], : leaf.shape[1]]
    (top, left), (bottom, right) = cells.min(axis=0), cells.max(axis=0)
    inside = (y >= top) & (y <= bottom) & (x >= left) & (x <= right)
    for (ay, ax), (by, bx) in zip(corners, corners[1:] + corners[:1], strict=True):
        inside = inside & ((by - ay) * (x - ax) >= (bx - ax) * (y - ay))
    radius = max(1, int(MARGIN_SHARE * np.sqrt(leaf.sum())))
    return eroded(inside, ellipse(2 * radius + 1))


def otsu(levels: np.ndarray) -> int:
    """The level up to which values are one class, with the most variance between the two."""
    share = np.bincount(levels.ravel(), minlength=256) / levels.size
    low, mass = np.cumsum(share), np.cumsum(share * np.arange(256))
    spread = low * (1 - low)
    return int(np.argmax(np.where(spread > 1e-12, (mass[-1] * low - mass) ** 2 / np.maximum(spread, 1e-12), 0)))


def joint_otsu(red: np.ndarray, yellow: np.ndarray, bins: int = 64) -> tuple[float, float]:
    """The red and yellow levels that bound the quadrant whose mean differs most, weighted, from that of all else."""
    counts = np.zeros((bins, bins))
    np.add.at(counts, tuple(np.minimum(v * bins // 255, bins - 1) for v in (red, yellow)), 1)
    centre = (np.arange(bins) + 0.5) * 255 / bins
    low, by_red, by_yellow = (np.cumsum(np.cumsum(m / max(counts.sum(), 1), 0), 1) for m in (counts, counts * centre[:, None], counts * centre))
    spread = low * (1 - low)
    between = (by_red - by_red[-1, -1] * low) ** 2 + (by_yellow - by_yellow[-1, -1] * low) ** 2
    score = np.where((low > 1e-9) & (low < 1 - 1e-9), between / np.maximum(spread, 1e-18), -1)
    if score.max() < 0:
        return 128.0, 128.0
    i, j = np.unravel_index(np.argmax(score), score.shape)
    return float((i + 1) * 255 / bins), float((j + 1) * 255 / bins)


def texture(level: np.ndarray) -> np.ndarray:
    """The mean strength, 0 to 1, of waves in four directions, each relative to its strongest cell."""
    answers = [np.abs(filtered(level, directed_wave(np.deg2rad(a), WAVE_LENGTH, WAVE_WIDTH))) for a in WAVE_ANGLES]
    return np.mean([a / (a.max() or 1) for a in answers], axis=0)


def _blurred(grid: np.ndarray, scale: float) -> np.ndarray:
    r = int(4 * scale + 0.5)
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / scale) ** 2)
    weight /= weight.sum()
    h, w = grid.shape
    padded = np.pad(grid, ((r, r), (0, 0)), mode="symmetric")
    grid = sum(v * padded[k : k + h] for k, v in enumerate(weight))
    padded = np.pad(grid, ((0, 0), (r, r)), mode="symmetric")
    return sum(v * padded[:, k : k + w] for k, v in enumerate(weight))


def vesselness(grid: np.ndarray, dark: bool) -> np.ndarray:
    """Frangi's measure of ridges (dark or bright ones), 0 to 1, the largest over all scales, from the Hessian's eigenvalues."""
    best = np.zeros(grid.shape)
    if min(grid.shape) < 2:
        return best
    for scale in RIDGE_SCALES:
        dy, dx = np.gradient(_blurred(grid if dark else -grid, scale))
        (yy, yx), (_, xx) = np.gradient(dy), np.gradient(dx)
        middle, half = (yy + xx) / 2, np.hypot((yy - xx) / 2, yx)
        pair = np.stack([middle - half, middle + half])
        across = np.where(np.abs(pair[0]) > np.abs(pair[1]), *pair)
        along = middle * 2 - across
        size = np.hypot(across, along)
        if size.max() <= 0:
            continue
        ridge = np.exp(-2 * (along / np.maximum(across, 1e-10)) ** 2) * (1 - np.exp(-2 * (size / size.max()) ** 2))
        best = np.maximum(best, np.where(across > 0, ridge, 0))
    return best


@dataclass(frozen=True)
class Picture:
    """An image with what is computed of it once."""

    rgb: np.ndarray

    @cached_property
    def colours(self) -> np.ndarray:
        return lab(self.rgb)

    @cached_property
    def grey(self) -> np.ndarray:
        return grey(self.rgb)

    @cached_property
    def grey_texture(self) -> np.ndarray:
        return texture(self.grey)

    @cached_property
    def ridges(self) -> tuple[np.ndarray, np.ndarray]:
        return vesselness(self.colours[..., 0] / 255, dark=False), vesselness(self.colours[..., 1] / 255, dark=True)

    def vein_weight(self, leaf: np.ndarray) -> np.ndarray:
        """0 on the leaf's strongest ridges and outside the leaf, 1 where there are none."""
        strengths = [r / top if (top := r[leaf].max(initial=0)) > 1e-6 else r for r in self.ridges]
        return (1 - np.sqrt(np.clip(np.maximum(*strengths), 0, 1))) * leaf

    def enhanced(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        light, red, yellow = np.moveaxis(self.colours, -1, 0)
        return within(stretched(light), leaf, 2.0), within(red, leaf, 1.0), yellow

    def two_textures(self, red: np.ndarray) -> np.ndarray:
        spread = (red - red.min()) * 255 // (np.ptp(red) or 1)
        return (1 - WAVE_RED_SHARE) * self.grey_texture + WAVE_RED_SHARE * texture(spread)


def least_levels(red: np.ndarray, yellow: np.ndarray, leaf: np.ndarray, category: str) -> tuple[float, float]:
    """The red and yellow levels a symptom starts at: the leaf's own thresholds within the category's bounds.

    Streaks are cut jointly on leaves of 200 cells or more; else each colour has its own cut on leaves of over 100 cells.
    """
    kind = SYMPTOMS[category]
    n = int(leaf.sum())
    if category == "MSV" and n >= 200:
        cuts = joint_otsu(red[leaf], yellow[leaf])
    elif n > 100:
        cuts = (otsu(red[leaf]), otsu(yellow[leaf]))
    else:
        cuts = (0, 0)
    return min(max(cuts[0], kind.red), kind.red_most), min(max(cuts[1], kind.yellow), kind.yellow_most)


def hard_mask(picture: Picture, leaf: np.ndarray, category: str) -> np.ndarray:
    """The leaf's cells with symptoms."""
    light, red, yellow = picture.enhanced(leaf)
    red_from, yellow_from = (int(v) for v in least_levels(red, yellow, leaf, category))
    found = (red >= red_from) | (yellow >= yellow_from)
    if category == "MLN":
        found |= (light < 110) & (red >= 125)
    found &= (red >= GREENER_IS_HEALTHY) & leaf
    if category == "MLN":
        found &= interior(leaf)
    if category == "MSV":
        found &= picture.two_textures(red) >= TEXTURE_HARD
    found = streaks(found, category, found.sum() / max(leaf.sum(), 1))
    return found & (picture.vein_weight(leaf) >= SYMPTOMS[category].vein_weight) if found.any() else found


def soft_confidence(picture: Picture, leaf: np.ndarray, category: str) -> np.ndarray:
    """The confidence, 0 to 1, that a cell has symptoms: how far its colours lie beyond the least levels."""
    light, red, yellow = picture.enhanced(leaf)
    ramps = [np.clip((v - low) / (255 - low), 0, 1) for v, low in zip((red, yellow), least_levels(red, yellow, leaf, category), strict=True)]
    if category == "MLN":
        ramps.append(np.where(red >= 125, np.clip((110 - light) / 110, 0, 1), 0))
    sure = np.max(ramps, axis=0) * (red >= GREENER_IS_HEALTHY) * leaf
    if category == "MLN":
        sure = sure * interior(leaf)
    if category == "MSV":
        sure = sure * (picture.two_textures(red) >= TEXTURE_SOFT)
    if sure.max() > 0:
        hint = sure > 0
        sure = sure * streaks(hint, category, hint.sum() / max(leaf.sum(), 1)) * picture.vein_weight(leaf)
    return sure


def damped(symptom: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A healthy leaf's symptoms: none below 1 % of the leaf or beyond 15 %, weak ones below 4 %."""
    share = (symptom > 0).sum() / leaf.sum() if leaf.any() else 0.0
    if share < HEALTHY_ZERO or share > HEALTHY_CEILING:
        return symptom * 0.0
    return symptom * HEALTHY_FACTOR if share < HEALTHY_DAMPED else symptom


def _bracket(value: float, brackets: list) -> float | None:
    for low, high, result in brackets:
        if (low is None or value >= low) and (high is None or value < high):
            return result
    return brackets[-1][2]


def fan_out(rgb: np.ndarray, prob: np.ndarray, category: str) -> list[dict]:
    """An image's four pseudo-labels: leaves by grey threshold, by refined and by raw probabilities, and a soft one.

    A leaf without cells, or an image whose refined leaf covers too little to have a weight, has severity and grade -1. Soft
    symptoms count towards severity from 0.3 on. Modes c and d carry the probabilities as their silhouette.
    """
    picture, refined = Picture(rgb), silhouette_of(prob)
    coverage = refined.mean()
    weight = _bracket(coverage, COVERAGE_WEIGHTS)
    leaves = {"mode_a": picture.grey > otsu(picture.grey), "mode_b": refined, "mode_c": prob >= SILHOUETTE_FROM, "mode_d": refined}
    out = []
    for mode, leaf in leaves.items():
        soft = mode == "mode_d"
        symptom = soft_confidence(picture, leaf, category) if soft else hard_mask(picture, leaf, category).astype(float)
        if category == "HEALTHY":
            symptom = damped(symptom, leaf)
        cells = (symptom >= 0.3 if soft else symptom > 0).sum()
        severity = float(100 * cells / leaf.sum()) if leaf.any() and weight is not None else -1.0
        grade = -1 if severity < 0 else 0 if category == "HEALTHY" else _bracket(severity, SEVERITY_GRADES)
        out.append({
            "mode": mode,
            "coverage": round(float(coverage), 4),
            "weight": -1.0 if weight is None else float(weight),
            "severity": round(severity, 4),
            "grade": int(grade),
            "silhouette": (prob if mode in ("mode_c", "mode_d") else leaf.astype(float)).round(6).ravel().tolist(),
            "symptom": symptom.round(6).ravel().tolist(),
        })
    return out


def boundary_weight(mask: np.ndarray, width: float = 15, floor: float = 0.1) -> np.ndarray:
    """1 at a mask's boundary, less in proportion to the distance from it, and the floor far away or without a mask."""
    return np.clip(1 - edge_distance(mask) / width, floor, 1) if mask.any() else np.full(mask.shape, floor)
