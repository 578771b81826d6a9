"""Binned data behind the charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ["split", "event"]


def _widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range of no width is widened by a half on both sides."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def _place(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the last one is closed on both sides."""
    return F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def histogram(values: DataFrame, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Bins of ``value`` per (split, event): bin, lo, hi, and count or weight.

    Empty bins are kept. The ranges table has one row per split and outcome.
    """
    present = values.filter(F.col("value").isNotNull())
    lo, hi = _widened(F.min("value"), F.max("value"))
    ranges = present.groupBy(*GROUP).agg(lo.alias("_lo"), hi.alias("_hi"))
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    filled = (
        present.join(F.broadcast(ranges), GROUP)
        .withColumn("bin", _place(F.col("value"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*GROUP, "bin")
        .agg(amount.alias("amount"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    frame = ranges.withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    ).select(
        *GROUP, "bin", (F.col("_lo") + width * F.col("bin")).alias("lo"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"),
    )
    kind = "bigint" if weight is None else "double"
    amount = F.coalesce(F.col("amount").cast(kind), F.lit(0).cast(kind))
    return frame.join(filled, [*GROUP, "bin"], "left").withColumn("amount", amount)


def _ranges(points: DataFrame, x: str, y: str) -> DataFrame:
    """Range of both axes, one row per split."""
    x_lo, x_hi = _widened(F.min(x), F.max(x))
    y_lo, y_hi = _widened(F.min(y), F.max(y))
    return points.groupBy("split").agg(
        x_lo.alias("_xlo"), x_hi.alias("_xhi"), y_lo.alias("_ylo"), y_hi.alias("_yhi")
    )


def bins2d(points: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts on a square grid per split; empty cells are left out."""
    points = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return (
        points.join(F.broadcast(_ranges(points, x, y)), "split")
        .groupBy(
            "split",
            _place(F.col(x), F.col("_xlo"), F.col("_xhi"), bins).alias("x_bin"),
            _place(F.col(y), F.col("_ylo"), F.col("_yhi"), bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hexbins(points: DataFrame, x: str, y: str, across: int = 10) -> DataFrame:
    """Counts on a hexagonal grid per split; empty hexagons are left out.

    The centres are two lattices of ``across`` columns, one moved by half a cell in both directions; a point belongs
    to the nearer of its two nearest centres, to the second lattice if both are equally near. A cell is as
    many times higher than wide, in units of the ranges, as makes the hexagons regular. Columns: split, lattice (0 or
    1), x_no, y_no, the centre's x and y, n. Points without one of the coordinates are in none.
    """
    down = max(1, int(across / 3**0.5))
    points = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    wide, high = (F.col("_xhi") - F.col("_xlo")) / across, (F.col("_yhi") - F.col("_ylo")) / down
    u, v = (F.col(x) - F.col("_xlo")) / wide, (F.col(y) - F.col("_ylo")) / high
    cells = points.join(F.broadcast(_ranges(points, x, y)), "split").select("split", u.alias("u"), v.alias("v"), wide.alias("wide"), high.alias("high"), "_xlo", "_ylo")

    def distance(shift: float) -> Column:
        sides = [F.col(c) - F.floor(F.col(c) + (0.5 - shift)) - shift for c in "uv"]
        return sides[0] * sides[0] + 3 * sides[1] * sides[1]

    lattice = F.when(distance(0.0) < distance(0.5), 0).otherwise(1)
    cells = cells.withColumn("lattice", lattice)
    half = F.col("lattice") * 0.5
    cells = cells.withColumns({f"{a}_no": F.floor(F.col(c) + (0.5 - half)).cast("int") for a, c in (("x", "u"), ("y", "v"))})
    at = [F.min(F.col(f"_{a}lo") + F.col(size) * (F.col(f"{a}_no") + half)).alias(a) for a, size in (("x", "wide"), ("y", "high"))]
    return cells.groupBy("split", "lattice", "x_no", "y_no").agg(*at, F.count(F.lit(1)).alias("n"))


def kde2d(
    points: DataFrame, x: str, y: str, weight: str, bandwidth: float, grid: int = 12
) -> DataFrame:
    """Weighted Gaussian density on a grid per split.

    Each level's kernel is added to every grid point; the sums are formed in
    each task, so that only grid points are shuffled.
    """
    points = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    spots = F.sequence(F.lit(0), F.lit(grid - 1))

    def at(axis: str) -> Column:
        step = (F.col(f"_{axis}hi") - F.col(f"_{axis}lo")) / (grid - 1)
        return F.col(f"_{axis}lo") + step * F.col(f"{axis}_no")

    distance = F.pow(F.col(x) - at("x"), 2) + F.pow(F.col(y) - at("y"), 2)
    kernel = F.col(weight) * F.exp(-distance / (2 * bandwidth**2))
    return (
        points.join(F.broadcast(_ranges(points, x, y)), "split")
        .withColumn("x_no", F.explode(spots))
        .withColumn("y_no", F.explode(spots))
        .groupBy("split", "x_no", "y_no")
        .agg(
            F.min(at("x")).alias("x"),
            F.min(at("y")).alias("y"),
            (F.sum(kernel) / F.sum(weight) / F.lit(2 * bandwidth**2) / F.pi()).alias("density"),
        )
    )


def density_error(bandwidth: float, fineness: int = 16, reach: float = 6.0) -> float:
    """The most by which ``binned_density`` differs from ``kde2d`` anywhere.

    Between lattice places the kernel is replaced by a line: off by at most an eighth of the squared spacing times its
    second derivative, on each axis. A kernel value that is cut off is at most exp(-reach² / 2).
    """
    return (0.25 / fineness**2 + math.exp(-(reach**2) / 2)) / (2 * math.pi * bandwidth**2)


def binned_density(
    points: DataFrame, x: str, y: str, weight: str, bandwidth: float, grid: int = 12, fineness: int = 16, reach: float = 6.0
) -> DataFrame:
    """The density of ``kde2d`` by linear binning and one pass an axis, within ``density_error``.

    Every point's weight is dealt to the four places around it on a lattice that holds the grid and is at least
    ``fineness`` times finer than the bandwidth: four rows a point whatever the grid, added up in each task
    before they are shuffled. The kernel is a product, so the weights of a lattice row go to the grid's columns
    first, and those sums to its rows, each to the grid points within ``reach`` bandwidths. After the binning, work
    grows with the occupied places only. Points without a coordinate or weight are left out; a split without weight has
    null densities. Columns as of ``kde2d``, one row for every grid point.
    """
    points = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull())
    ranges = _ranges(points, x, y)
    for a in "xy":
        step = (F.col(f"_{a}hi") - F.col(f"_{a}lo")) / (grid - 1)
        ranges = ranges.withColumn(f"_{a}step", step)
        # lattice places from one grid point to the next
        ranges = ranges.withColumn(f"_{a}parts", F.ceil(F.col(f"_{a}step") * fineness / bandwidth).cast("long"))
    placed = points.join(F.broadcast(ranges), "split")
    for a, c in (("x", x), ("y", y)):
        spacing = F.col(f"_{a}step") / F.col(f"_{a}parts")
        placed = placed.withColumn(f"_{a}at", (F.col(c) - F.col(f"_{a}lo")) / spacing)

    def sides(a: str) -> Column:
        at, low = F.col(f"_{a}at"), F.floor(F.col(f"_{a}at"))
        pair = F.array(*(F.struct(no.alias("no"), part.alias("part")) for no, part in ((low, 1 - (at - low)), (low + 1, at - low))))
        return F.explode(F.filter(pair, lambda s: s["part"] > 0))

    corners = placed.withColumn("_xs", sides("x")).withColumn("_ys", sides("y"))
    dealt = corners.groupBy("split", F.col("_xs.no").alias("_x"), F.col("_ys.no").alias("_y")).agg(
        F.sum(F.col(weight) * F.col("_xs.part") * F.col("_ys.part")).alias("_w")
    )

    def spread(sums: DataFrame, a: str, keys: list[str]) -> DataFrame:
        """The sums along an axis, brought to its grid points."""
        spacing = F.col(f"_{a}step") / F.col(f"_{a}parts")
        far = F.floor(F.lit(reach * bandwidth) / spacing)
        place, parts = F.col(f"_{a}"), F.col(f"_{a}parts")
        near = F.filter(F.sequence(F.lit(0), F.lit(grid - 1)), lambda g: F.abs(place - g * parts) <= far)
        gap = (F.col(f"_{a}") - F.col(f"{a}_no") * parts) * spacing
        kernel = F.exp(-(gap * gap) / (2 * bandwidth**2))
        return (
            sums.join(F.broadcast(ranges), "split")
            .withColumn(f"{a}_no", F.explode(near))
            .groupBy("split", f"{a}_no", *keys)
            .agg(F.sum(F.col("_w") * kernel).alias("_w"))
        )

    sums = spread(spread(dealt, "x", ["_y"]), "y", ["x_no"])
    totals = points.groupBy("split").agg(F.sum(weight).alias("_all"))
    spots = F.sequence(F.lit(0), F.lit(grid - 1))
    frame = ranges.join(totals, "split").withColumn("x_no", F.explode(spots)).withColumn("y_no", F.explode(spots))
    scale = F.lit(2 * bandwidth**2) * F.pi()
    return frame.join(sums, ["split", "x_no", "y_no"], "left").select(
        "split", "x_no", "y_no",
        *((F.col(f"_{a}lo") + F.col(f"_{a}step") * F.col(f"{a}_no")).alias(a) for a in "xy"),
        (F.coalesce("_w", F.lit(0.0)) / F.nullif(F.col("_all"), F.lit(0)) / scale).alias("density"),
    )
