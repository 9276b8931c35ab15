"""Masks as sorted runs of set cells, [start, end) over a frame's cells column by column: column functions without decoded cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import let

RUN = "array<struct<start: bigint, end: bigint>>"


def _run(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def covered(masks: list[Column], least: int) -> Column:
    """Runs of the cells that ``least`` of the masks hold at least, by one sweep over all starts and ends; touching runs are one.

    Null if a mask is null.
    """
    events = F.flatten(F.array(*[F.flatten(F.transform(m, lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(-1).alias("way")), F.struct(r["end"].alias("at"), F.lit(1).alias("way"))))) for m in masks]))
    state = lambda depth, opened, runs: F.struct(depth.alias("depth"), opened.alias("opened"), runs.alias("runs"))

    def step(s: Column, e: Column) -> Column:
        now = s["depth"] - e["way"]  # starts come before ends at one place
        closes = (s["depth"] >= least) & (now < least) & (e["at"] > s["opened"])
        return state(now, F.when((s["depth"] < least) & (now >= least), e["at"]).otherwise(s["opened"]), F.when(closes, F.concat(s["runs"], F.array(_run(s["opened"], e["at"])))).otherwise(s["runs"]))

    return F.aggregate(F.sort_array(events), state(F.lit(0), F.lit(-1).cast("long"), F.array().cast(RUN)), step)["runs"]


def union(*masks: Column) -> Column:
    return covered(list(masks), 1)


def intersection(*masks: Column) -> Column:
    return covered(list(masks), len(masks))


def area(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def iou(a: Column, b: Column, empty: float = 1.0) -> Column:
    """The share of cells in both masks among those in either; ``empty`` if both are empty."""
    sizes = F.struct(area(intersection(a, b)).alias("both"), (area(a) + area(b)).alias("sum"))
    return let(sizes, lambda s: F.when(s["sum"] == 0, F.lit(empty)).otherwise(s["both"] / (s["sum"] - s["both"])))


def from_lengths(lengths: Column) -> Column:
    """Runs of run lengths that begin with zeros."""
    state = lambda at, runs: F.struct(at.alias("at"), runs.alias("runs"))
    numbered = F.transform(lengths, lambda n, i: F.struct((i % 2).alias("set"), n.cast("long").alias("n")))
    step = lambda s, r: state(s["at"] + r["n"], F.when((r["set"] == 1) & (r["n"] > 0), F.concat(s["runs"], F.array(_run(s["at"], s["at"] + r["n"])))).otherwise(s["runs"]))
    return union(F.aggregate(numbered, state(F.lit(0).cast("long"), F.array().cast(RUN)), step)["runs"])


def to_lengths(mask: Column, cells: Column) -> Column:
    """Run lengths, beginning with zeros, of a frame of ``cells`` cells."""
    ends = F.concat(F.flatten(F.transform(mask, lambda r: F.array(r["start"], r["end"]))), F.array(cells.cast("long")))
    lengths = F.transform(ends, lambda e, i: e - F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)))
    return F.when((F.size(lengths) > 1) & (F.element_at(lengths, -1) == 0), F.slice(lengths, 1, F.size(lengths) - 1)).otherwise(lengths)


def filled(points: Column, width: Column, height: Column) -> Column:
    """Runs of the cells whose middle lies in a polygon (points [x, y] in cells, even-odd rule), column by column.

    Only the columns that the polygon spans are scanned; of each the edges that cross its middle give sorted crossings,
    each two of which are a run. Under three points, or a null, give an empty mask.
    """
    edges = F.zip_with(points, F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)), lambda p, q: F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")))
    xs = F.transform(points, lambda p: p[0])
    first, last = F.greatest(F.lit(0), F.floor(F.array_min(xs)).cast("int")), F.least(width - 1, F.floor(F.array_max(xs)).cast("int"))
    clip = lambda v: F.least(F.greatest(F.ceil(v - 0.5), F.lit(0)), height.cast("long"))

    def column(x: Column) -> Column:
        middle = x + F.lit(0.5)
        crossing = F.filter(edges, lambda e: (e["x0"] <= middle) != (e["x1"] <= middle))
        ys = F.sort_array(F.transform(crossing, lambda e: e["y0"] + (middle - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])))
        paired = lambda ys: F.transform(F.filter(F.transform(ys, lambda y, i: F.struct(y.alias("y"), F.get(ys, i + 1).alias("z"), (i % 2).alias("odd"))), lambda s: s["odd"] == 0), lambda s: _run(x * height + clip(s["y"]), x * height + clip(s["z"])))
        return F.filter(let(ys, paired), lambda r: r["end"] > r["start"])

    shape = (F.size(points) >= 3) & (last >= first)
    return F.when(F.coalesce(shape, F.lit(False)), union(F.flatten(F.transform(F.sequence(first, F.greatest(first, last)), column)))).otherwise(F.array().cast(RUN))
