"""Leaf and picture kernels against plain versions that go cell by cell, or against what they promise."""

import colorsys
import math
import struct
import zlib

import numpy as np
import pytest

from millrace.functions import leaves as L
from millrace.functions import pixels as P
from millrace.sources import pictures as R


def test_lab_has_the_known_colours():
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20)}
    got = L.lab(np.array([list(known)]))[0]
    assert np.abs(got - np.array(list(known.values()))).max() <= 1


@pytest.mark.parametrize("span", [0, 90, 180, 181, 255])
def test_stretching_leaves_wide_and_flat_images(span):
    level = np.array([[10, 10 + span]]) if span < 246 else np.array([[0, 255]])
    want = [[0, 255]] if 0 < span <= 180 else level.tolist()
    assert L.stretched(level).tolist() == want


def plain_sweep(mask, shape, every):
    r, out = [n // 2 for n in shape.shape], np.zeros_like(mask)
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            seen = [mask[y + a - r[0], x + b - r[1]] if 0 <= y + a - r[0] < h and 0 <= x + b - r[1] < w else every for a, b in np.argwhere(shape)]
            out[y, x] = all(seen) if every else any(seen)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_openings_and_closings(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((17, 23)) < 0.7
    for shape in (L.ellipse(5), L.line(7, 30 * seed), L.ellipse(3)):
        assert (L.eroded(mask, shape) == plain_sweep(mask, shape, True)).all()
        assert (L.dilated(mask, shape) == plain_sweep(mask, shape, False)).all()
        assert not (L.opened(mask, shape) & ~mask).any() and (L.opened(L.opened(mask, shape), shape) == L.opened(mask, shape)).all()
        assert not (mask & ~L.closed(mask, shape)).any()


def test_shapes():
    assert L.ellipse(5).astype(int).tolist() == [[0, 0, 1, 0, 0], [1] * 5, [1] * 5, [1] * 5, [0, 0, 1, 0, 0]]
    assert L.line(7, 0)[3].all() and L.line(7, 0).sum() == 7 and L.line(7, 90)[:, 3].all()
    for angle in L.OPENING_ANGLES:
        shape = L.line(15, angle)
        assert shape.sum() == 15 or angle % 90 and 11 <= shape.sum() <= 15
        assert (shape == shape[::-1, ::-1]).all() and (L.line(15, 180 - angle) == shape[:, ::-1]).all()


def test_streaks_survive_along_lines_only():
    mask = np.zeros((40, 40), bool)
    mask[20, 5:25] = True
    slanted = mask.copy()
    slanted[2, 2] = True
    assert (L.streaks(slanted, "MSV", 0.01) == mask).all()
    assert not L.streaks(mask, "HEALTHY", 0.01).any() and L.streaks(mask.T, "HEALTHY", 0.5).sum() == 20


@pytest.mark.parametrize("seed", range(4))
def test_interior_is_the_eroded_hull(seed):
    rng = np.random.default_rng(seed)
    leaf = np.zeros((40, 44), bool)
    for y, x in rng.integers(8, 32, (6, 2)):
        leaf[y - 4 : y + 5, x - 4 : x + 5] = True
    leaf[0, 0] = True  # a speck isn't the leaf
    cells = np.argwhere(L.largest_component(leaf))
    inside = np.zeros_like(leaf)
    for y in range(40):
        for x in range(44):
            away = np.sort(np.arctan2(cells[:, 0] - y, cells[:, 1] - x))
            here = (cells == (y, x)).all(axis=1).any()
            inside[y, x] = here or np.diff(np.append(away, away[0] + 2 * math.pi)).max() <= math.pi + 1e-9
    radius = max(1, int(0.08 * math.sqrt(leaf.sum())))
    assert (L.interior(leaf) == plain_sweep(inside, L.ellipse(2 * radius + 1), True)).all()
    assert not L.interior(np.zeros((5, 5), bool)).any()


@pytest.mark.parametrize("seed", range(4))
def test_thresholds_have_the_most_variance_between(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(90, 9, 300), rng.normal(160, 20, 200)]).clip(0, 255).astype(int)
    between = lambda t: (v <= t).mean() * (v > t).mean() * (v[v <= t].mean() - v[v > t].mean()) ** 2 if (v <= t).any() and (v > t).any() else 0
    assert between(L.otsu(v)) == pytest.approx(max(map(between, range(256))))
    w = np.concatenate([rng.normal(100, 9, 300), rng.normal(150, 20, 200)]).clip(0, 255).astype(int)
    edge = np.arange(1, 65) * 255 / 64
    a, b = (np.minimum(x * 64 // 255, 63) for x in (v, w))
    middle = (np.arange(64) + 0.5) * 255 / 64
    best = {}
    for i in range(64):
        for j in range(64):
            low = (a <= i) & (b <= j)
            if 0 < low.mean() < 1:
                gap = (middle[a][low].mean() - middle[a][~low].mean()) ** 2 + (middle[b][low].mean() - middle[b][~low].mean()) ** 2
                best[edge[i], edge[j]] = low.mean() * (1 - low.mean()) * gap
    assert best[L.joint_otsu(v, w)] == pytest.approx(max(best.values()))
    assert L.joint_otsu(np.full(9, 3), np.full(9, 3)) == (128.0, 128.0)


def test_filters_are_sums_over_mirrored_surroundings():
    g = np.random.default_rng(1).random((9, 12))
    kernel = P.directed_wave(0.7, 6.0, 2.0, 5)
    padded = np.pad(g, 2, mode="reflect")
    want = [[(padded[y : y + 5, x : x + 5] * kernel).sum() for x in range(12)] for y in range(9)]
    assert np.allclose(P.filtered(g, kernel), want)


def test_texture_answers_to_waves():
    waves = np.round(128 + 100 * np.cos(2 * np.pi * np.arange(60) / 10)) * np.ones((60, 1))
    assert L.texture(waves).mean() > 2 * L.texture(np.random.default_rng(0).integers(120, 136, (60, 60))).max() * 0.1
    answers = [np.abs(P.filtered(waves - 128, P.directed_wave(np.deg2rad(a), 10.0, 4.0))).max() for a in L.WAVE_ANGLES]
    assert answers[0] > 5 * answers[2] and L.texture(np.zeros((8, 8))).max() == 0


def test_texture_vectors():
    g = np.random.default_rng(3).random((16, 16))
    v = P.texture_vector(g)
    assert len(v) == 58 and sum(v[32:]) == pytest.approx(1)
    wave = P.filtered(g, P.directed_wave(np.pi / 4, 10.0, 4.0))
    assert v[2:4] == pytest.approx([wave.mean(), wave.std()])
    flat = P.turning_patterns(np.full((20, 20), 5.0))
    assert (flat[4:-4, 4:-4] == 24).all()
    y, x, r = 8, 8, 3
    bits = []
    for k in range(24):
        py, px = y - r * math.sin(2 * math.pi * k / 24), x + r * math.cos(2 * math.pi * k / 24)
        iy, ix = math.floor(py + 1e-6), math.floor(px + 1e-6)
        fy, fx = py - iy, px - ix
        at = g[iy, ix] * (1 - fy) * (1 - fx) + g[iy, ix + 1] * (1 - fy) * fx + g[iy + 1, ix] * fy * (1 - fx) + g[iy + 1, ix + 1] * fy * fx
        bits.append(at >= g[y, x])
    turns = sum(p != q for p, q in zip(bits, bits[1:] + bits[:1], strict=True))
    assert P.turning_patterns(g)[y, x] == (sum(bits) if turns <= 2 else 25)


def test_ridges():
    grid = np.zeros((48, 48))
    grid[:, 24] = 1
    bright, dark = L.vesselness(grid, dark=False), L.vesselness(grid, dark=True)
    assert bright[24, 24] > 0.6 and dark[24, 24] == 0 and np.allclose(L.vesselness(-grid, dark=True), bright)
    y, x = np.mgrid[:48, :48]
    blob = np.exp(-((y - 24) ** 2 + (x - 24) ** 2) / 18)
    assert L.vesselness(blob, dark=False)[24, 24] < 0.3 < bright[24, 24]  # a round blob is no ridge
    assert not L.vesselness(np.ones((6, 6)), dark=True).any() and L.vesselness(np.ones((1, 4)), dark=True).shape == (1, 4)


@pytest.mark.parametrize("seed", range(3))
def test_distances_to_the_other_kind(seed):
    mask = np.random.default_rng(seed).random((9, 14)) < 0.2
    cells = [(y, x) for y in range(9) for x in range(14)]
    want = [min((math.hypot(y - b, x - a) for b, a in cells if mask[b, a] != mask[y, x]), default=math.inf) for y, x in cells]
    assert np.allclose(P.edge_distance(mask).ravel(), want)
    assert np.isinf(P.edge_distance(np.ones((3, 3), bool))).all() and (L.boundary_weight(np.zeros((2, 2), bool)) == 0.1).all()


def disc(side, radius):
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    return np.hypot(y, x) <= radius


def leaf_picture(colour, side=80):
    """A disc of one green with streaks of the given colour, on black."""
    rgb = np.zeros((side, side, 3))
    leaf = disc(side, side * 0.4)
    rgb[leaf] = (60, 150, 60)
    for x in range(side // 3, side * 2 // 3, 10):
        rgb[side // 3 : side * 2 // 3, x : x + 5] = colour
    return rgb, leaf


def test_symptoms_are_found_where_they_are():
    rgb, leaf = leaf_picture((200, 170, 60))
    sick = (rgb == (200, 170, 60)).all(axis=2)
    for category in ("MSV", "MLN"):
        picture = L.Picture(rgb)
        hard, soft = L.hard_mask(picture, leaf, category), L.soft_confidence(picture, leaf, category)
        assert not (hard & ~leaf).any() and soft.min() >= 0 and soft.max() <= 1
        near = L.dilated(sick, L.ellipse(5))
        assert not ((soft > 0) & ~near).any() and not (hard & ~near).any()
        assert (soft > 0)[sick].mean() > 0.2, category
    assert not L.hard_mask(L.Picture(np.where(leaf[..., None], (60, 150, 60), 0)), leaf, "MSV").any()
    assert not L.hard_mask(L.Picture(rgb), np.zeros_like(leaf), "MLN").any()


def test_least_levels_stay_within_bounds():
    rng = np.random.default_rng(0)
    for low, high in ((0, 90), (120, 160), (200, 255)):
        red, yellow = rng.integers(low, high, (2, 30, 30))
        for category, kind in L.SYMPTOMS.items():
            for leaf in (disc(30, 14), disc(30, 6), disc(30, 3), disc(30, 0)):
                a, b = L.least_levels(red, yellow, leaf, category)
                assert kind.red <= a <= kind.red_most and kind.yellow <= b <= kind.yellow_most
                if leaf.sum() <= 100:
                    assert (a, b) == (kind.red, kind.yellow)


@pytest.mark.parametrize(("cells", "factor"), [(0, 0), (9, 0), (10, 0.3), (39, 0.3), (40, 1), (150, 1), (151, 0), (900, 0)])
def test_healthy_leaves_are_damped(cells, factor):
    leaf, symptom = np.ones((25, 40), bool), np.zeros(1000)
    symptom[:cells] = 1
    assert (L.damped(symptom.reshape(25, 40), leaf).ravel() == symptom * factor).all()


def test_four_modes():
    rgb, leaf = leaf_picture((200, 170, 60))
    prob = np.where(leaf, 0.9, 0.1)
    prob[2, 2] = 0.8  # a speck that refining takes away
    rows = {r["mode"]: r for r in L.fan_out(rgb, prob, "MLN")}
    assert list(rows) == ["mode_a", "mode_b", "mode_c", "mode_d"]
    refined = L.silhouette_of(prob)
    assert not refined[2, 2] and rows["mode_b"]["silhouette"] == refined.astype(float).ravel().tolist()
    assert rows["mode_c"]["silhouette"] == rows["mode_d"]["silhouette"] == prob.ravel().tolist()
    hard = np.reshape(rows["mode_b"]["symptom"], leaf.shape) > 0
    assert rows["mode_b"]["severity"] == round(100 * hard.sum() / refined.sum(), 4) and rows["mode_b"]["weight"] == (1.0 if refined.mean() >= 0.5 else 0.7)
    soft = np.reshape(rows["mode_d"]["symptom"], leaf.shape)
    assert rows["mode_d"]["severity"] == round(100 * (soft >= 0.3).sum() / refined.sum(), 4)
    assert all(r["severity"] == r["grade"] == r["weight"] == -1 for r in L.fan_out(rgb, prob * 0, "MSV"))
    assert {r["grade"] for r in L.fan_out(rgb, prob, "HEALTHY")} == {0}
    for side in (1, 2, 3):
        assert len(L.fan_out(np.zeros((side, side, 3)), np.ones((side, side)), "MSV")) == 4


def test_modes_through_spark(spark):
    grid = [float(i % 7) for i in range(64)]
    rows = [(1, grid, grid, grid, [0.9] * 64, "MSV"), (2, grid, grid, None, grid, "MSV"), (3, grid, grid, grid, [0.9] * 4, "MLN"), (4, grid, grid, grid, grid, "other"), (5, [], [], [], [], "MLN"), (6, grid, grid, grid, grid, None)]
    df = spark.createDataFrame(rows, "k int, r array<double>, g array<double>, b array<double>, p array<double>, c string")
    got = {r["k"]: r["m"] for r in df.select("k", P.four_modes("r", "g", "b", "p", "c").alias("m")).collect()}
    assert len(got[1]) == 4 and all(got[k] is None for k in (2, 3, 4, 5, 6))


def file_of(header, lines, *extra):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return R.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *header)) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def filter_line(kind, now, before, step):
    out = []
    for i, v in enumerate(now):
        a, b, c = now[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
        p = a + b - c
        paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
        out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes([kind, *out])


@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_filtered_lines_are_undone(colour, samples, depth):
    rng = np.random.default_rng(colour)
    size = samples * depth // 8
    raw = rng.integers(0, 256, (11, 7 * size))
    lines = b"".join(filter_line(y % 5, raw[y].tolist(), raw[y - 1].tolist() if y else [0] * 7 * size, size) for y in range(11))
    got = R.read_picture(file_of((7, 11, depth, colour, 0, 0, 0), lines))
    first = raw.reshape(11, 7, samples, depth // 8)[..., 0]
    assert (got == (np.repeat(first[..., :1], 3, -1) if colour in (0, 4) else first[..., :3])).all()


def test_few_bits_palettes_and_interlacing():
    got = R.read_picture(file_of((5, 2, 2, 0, 0, 0, 0), bytes([0, 0b00011011, 0b11000000, 0, 0, 0])))
    assert got[..., 0].tolist() == [[0, 85, 170, 255, 255], [0] * 5]
    palette = (b"PLTE", bytes([9, 8, 7, 1, 2, 3]))
    assert R.read_picture(file_of((3, 1, 1, 3, 0, 0, 0), bytes([0, 0b01000000]), palette)).tolist() == [[[9, 8, 7], [1, 2, 3], [9, 8, 7]]]
    assert R.read_picture(file_of((3, 1, 8, 3, 0, 0, 0), bytes([0, 0, 1, 2]), palette)) is None
    for h, w in ((1, 1), (3, 5), (8, 8), (13, 9)):
        grid = np.random.default_rng(h).integers(0, 256, (h, w), np.uint8)
        lines = b"".join(b"\0" + row.tobytes() for y, x, dy, dx in R.PASSES if y < h and x < w for row in grid[y::dy, x::dx])
        assert (R.read_picture(file_of((w, h, 8, 0, 0, 0, 1), lines))[..., 1] == grid).all()


def test_orientations():
    g = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: g, 2: np.fliplr(g), 3: np.rot90(g, 2), 4: np.flipud(g), 5: g.T, 6: np.rot90(g, -1), 7: np.rot90(g.T, 2), 8: np.rot90(g), 9: g}
    for o, upright in want.items():
        for kind in (0, 2):
            assert (R.read_picture(R.write_png(g, o, kind))[..., 2] == upright).all(), o


def test_damaged_files_are_null(spark):
    whole = R.write_png(np.random.default_rng(0).integers(0, 256, (6, 5, 3)), 1)
    bad = [None, b"", b"text", whole[:-12], whole[: len(whole) // 2], whole[:60] + b"\x00" + whole[61:], R.SIGNATURE, file_of((5, 9, 8, 2, 0, 0, 0), b"\0" * 16), file_of((0, 9, 8, 2, 0, 0, 0), b""), file_of((1, 1, 8, 0, 0, 0, 0), b"\x07\x00")]
    assert [R.read_picture(b) for b in bad] == [None] * len(bad)
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate([*bad, whole])], "k int, content binary").coalesce(1)
    got = {r["k"]: r["p"] for r in df.select("k", R.decoded("content").alias("p")).collect()}
    assert all(got[k]["height"] is None and got[k]["rgb"] is None for k in range(len(bad)))
    assert (got[len(bad)]["height"], got[len(bad)]["width"]) == (6, 5) and bytes(got[len(bad)]["rgb"]) == R.read_picture(whole).tobytes()


def test_files_of_a_tree_are_decoded(spark, tmp_path):
    from millrace.sources.files import image_tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(R.write_png(np.full((2, 3), 7)))
    (tmp_path / "a" / "y.png").write_bytes(b"no picture")
    rows = image_tree(spark, str(tmp_path), content=True).select("filename", R.decoded("content").alias("p")).select("filename", "p.height", "p.width").collect()
    assert sorted(map(tuple, rows), key=str) == [("x.png", 2, 3), ("y.png", None, None)]


def test_grey_is_a_weighted_mean():
    rgb = [int(255 * v) for v in colorsys.hsv_to_rgb(0.3, 0.8, 0.6)]
    assert L.grey(np.array([[rgb]]))[0, 0] == round(0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2])


def test_modes_of_a_batch_go_out_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    grid = pa.array([[float(i % 7) for i in range(16)]] * 300)
    parts = list(P.four_modes.func(iter([(grid, grid, grid, grid, pa.array(["HEALTHY", None, "MLN"] * 100))])))
    assert [len(p) for p in parts] == [64, 64, 64, 64, 44] and sum(p.null_count for p in parts) == 100
