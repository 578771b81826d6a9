"""Multinomial logistic regression on one split of many levels and several of few.

Given the effects of the small splits, the levels of the largest do not bear on each
other: each is solved for where its events lie. What is left is a system of the small
splits' levels and the intercepts, which the driver solves. An event is a cell, its
combination of small levels and its class, and a row holds the cells of one large level.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.operators.rates import TOTAL
from splitlab.operators.solvers import KEYS, NotConverged, _Progress
from splitlab.session import discard, written

#: Coefficients of the small splits up to which the driver solves for them: a matrix of 8 MB.
DENSE = 1 << 10
#: Combinations of small levels, the missing one counted, up to which a task holds sums for each.
COMBINATIONS = 1 << 16
#: Events, and numbers of the large levels' curvature, that are worked on at once.
SLICE, CROSS = 1 << 16, 1 << 21
#: A step is shortened until the loss falls by this share of what its slope promises.
FALL = 1e-4
#: Steps for a large level's own effects; its slope is brought this far below the tolerance.
INNER, CLOSER = 60, 0.1
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Packed(NamedTuple):
    """``rows`` (level, cells, counts) of the split ``large``, and what the cells stand for."""

    rows: DataFrame
    large: str
    small: list[str]
    levels: list[list[str]]
    classes: list[str]
    totals: np.ndarray

    @property
    def labels(self) -> list[tuple[str, str]]:
        """(split, level) of each effect of the small splits; the intercept is last."""
        return [(s, x) for s, levels in zip(self.small, self.levels) for x in levels] + [(TOTAL, TOTAL)]

    @property
    def layout(self) -> Layout:
        return Layout([len(levels) for levels in self.levels], len(self.classes))


class Layout:
    """Places of the small levels in a combination; the missing level of a split comes after its others."""

    def __init__(self, sizes: list[int], width: int):
        self.sizes, self.width = sizes, width
        self.shape = [size + 1 for size in sizes]
        self.combinations = int(np.prod(self.shape, dtype=object))
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=int)])
        self.count = int(self.starts[-1]) + 1
        self.pairs = [(a, b) for a in range(width) for b in range(a + 1, width)]

    def square(self, cells: np.ndarray) -> np.ndarray:
        """(class, class, ...) out of the curvatures of the ``pairs``; over the classes they add up to nothing."""
        found = np.zeros((self.width, self.width, *cells.shape[1:]))
        for (a, b), cell in zip(self.pairs, cells):
            found[a, b] = found[b, a] = cell
            found[a, a] -= cell
            found[b, b] -= cell
        return found

    def places(self) -> list[np.ndarray]:
        return list(np.unravel_index(np.arange(self.combinations), self.shape))

    def scores(self, b: np.ndarray) -> np.ndarray:
        """(class, combination): the intercepts plus the effects ``b`` (place, class) of the small levels."""
        found = np.repeat(b[-1][:, None], self.combinations, axis=1)
        for start, size, place in zip(self.starts, self.sizes, self.places()):
            found += np.vstack([b[start : start + size], np.zeros(self.width)]).T[:, place]
        return found

    def by_level(self, cells: np.ndarray) -> np.ndarray:
        """Sums over the combinations, (kind, combination) to (place, kind)."""
        sums = [
            np.array([np.bincount(place, row, size + 1)[:size] for row in cells]).reshape(len(cells), size)
            for size, place in zip(self.sizes, self.places())
        ]
        return np.hstack([*sums, cells.sum(axis=1, keepdims=True)]).T

    def curvature(self, cells: np.ndarray) -> np.ndarray:
        """(place and class, place and class) out of the curvature of each combination (pair of classes, combination)."""
        n, k = self.count, self.width
        found = np.zeros((n, n, len(cells)))
        found[-1] = self.by_level(cells) if len(cells) else 0.0
        found[:, -1] = found[-1]
        places = self.places()
        for i, (at, size, place) in enumerate(zip(self.starts, self.sizes, places)):
            for at2, size2, place2 in zip(self.starts[i:], self.sizes[i:], places[i:]):
                code, shape = place * (size2 + 1) + place2, (size + 1, size2 + 1)
                for j, row in enumerate(cells):
                    block = np.bincount(code, row, shape[0] * shape[1]).reshape(shape)[:size, :size2]
                    found[at : at + size, at2 : at2 + size2, j] = block
                    found[at2 : at2 + size2, at : at + size, j] = block.T
        return self.square(np.moveaxis(found, 2, 0)).transpose(2, 0, 3, 1).reshape(n * k, n * k)


def _in_batches(rows: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of few megabytes, unless the session has its own limit."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(work, schema)


def packed(events: DataFrame, splits, most: int) -> Packed | None:
    """``design.equal_events`` by the levels of the largest split; None where the method does not apply.

    That is where there are no more than ``most`` coefficients in all, or where the other splits
    are above ``DENSE`` or ``COMBINATIONS``.
    """
    splits = list(splits)
    # one column is read at a time
    each = [events.select(F.lit(s).alias("split"), F.col(s).alias("level")).distinct() for s in (*splits, "event")]
    sizes = dict(reduce(DataFrame.union, each).groupBy("split").agg(F.count("level")).collect())
    width, sizes = sizes.pop("event", 0), {s: sizes.get(s, 0) for s in splits}
    large = max(splits, key=sizes.get)
    small = [s for s in splits if s != large]
    if sum(sizes.values()) * width <= most or (sum(sizes[s] for s in small) + 1) * width > DENSE:
        return None
    if np.prod([sizes[s] + 1 for s in small], dtype=object) > COMBINATIONS:
        return None
    totals = written(events.groupBy(*small, "event").agg(F.sum("n").alias("n")), "totals")
    names = [sorted(row[0] for row in totals.select(s).distinct().collect() if row[0] is not None) for s in (*small, "event")]
    levels, classes = names[:-1], names[-1]
    layout = Layout([len(x) for x in levels], len(classes))

    def numbered(rows: DataFrame) -> DataFrame:
        cell = F.lit(0)
        for name, known in zip((*small, "event"), names):
            # at most DENSE levels
            table = rows.sparkSession.createDataFrame([*zip(known, range(len(known)))], f"{name} string, _{name} int")
            rows = rows.join(F.broadcast(table), name, "left")
            missing = len(known) + (name != "event")
            cell = cell * missing + F.coalesce(F.col(f"_{name}"), F.lit(len(known)))
        return rows.withColumn("cell", cell.cast("int"))

    sums = np.zeros(layout.combinations * layout.width)
    for row in numbered(totals).select("cell", "n").collect():  # COMBINATIONS times the classes at most
        sums[row[0]] += row[1]
    discard(totals)
    # a level has no more cells than there are, however many its events
    rows = numbered(events).groupBy(F.col(large).alias("level")).agg(
        F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts")
    )
    return Packed(written(rows, "blocks"), large, small, levels, classes, sums.reshape(-1, layout.width))


def _slices(batch, most_rows: int):
    """Rows of a batch of at most ``SLICE`` events, or one row: (levels, lengths, cells, counts, batch from, to)."""
    levels, cells, counts = (batch.column(i) for i in range(3))
    lengths = np.diff(cells.offsets.to_numpy())
    ends = np.cumsum(lengths)
    cells, counts = cells.flatten().to_numpy(), counts.flatten().to_numpy()
    at = 0
    while at < len(ends):
        begin = ends[at] - lengths[at]
        to = max(at + 1, min(at + most_rows, int(np.searchsorted(ends, begin + SLICE, "right"))))
        end = ends[to - 1]
        yield levels.slice(at, to - at), lengths[at:to], cells[begin:end], counts[begin:end].astype(float), at, to
        at = to


class _Slice:
    """Events of some large levels: their weight, class, combination and scores before the large split."""

    def __init__(self, layout: Layout, scores, weights, lengths, cells, counts):
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.combination, self.cls = np.divmod(cells.astype(np.int64), layout.width)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.t = counts * weights[self.cls]
        self.base = scores[:, self.combination]
        self.seen = np.bincount(self.row * layout.width + self.cls, self.t, len(lengths) * layout.width)
        self.seen = self.seen.reshape(-1, layout.width)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the events by row, last axis first: (..., event) to (row, ...)."""
        return np.moveaxis(np.add.reduceat(values, self.starts, axis=-1), -1, 0)

    def shares(self, effects: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fitted share (class, event), and the loss by row."""
        scores = self.base + np.repeat(effects.T, self.lengths, axis=1)
        own = scores[self.cls, np.arange(len(self.cls))]
        top = scores.max(axis=0)
        scores -= top
        p = np.exp(scores, out=scores)
        total = p.sum(axis=0)
        p /= total
        return p, self.sums(self.t * (np.log(total) + top - own))

    def bend(self, p: np.ndarray, pairs):
        """The curvature of each event, one pair of classes after the other."""
        weighted = -self.t * p
        for a, b in pairs:
            yield weighted[a] * p[b]

    def solved(self, layout: Layout, there: np.ndarray, pen: float, goal: float):
        """Effects, shares, slope, curvature and loss of the rows, those not ``there`` without an effect."""
        eye = pen * np.eye(layout.width)
        effects = np.zeros(self.seen.shape)
        p, loss = self.shares(effects)
        size = self.seen.sum(axis=1, keepdims=True) + pen
        for _ in range(INNER):
            slope = (self.sums(self.t * p) - self.seen + pen * effects) * there[:, None]
            curves = np.array([self.sums(cells) for cells in self.bend(p, layout.pairs)])
            curves = layout.square(curves.reshape(-1, len(size))).transpose(2, 0, 1) + eye
            if (np.abs(slope) <= goal * size).all():
                break
            step = -np.linalg.solve(curves, slope[:, :, None])[:, :, 0]
            promise, length = (slope * step).sum(axis=1), np.ones(len(step))
            while True:
                moved = effects + length[:, None] * step
                p, now = self.shares(moved)
                now = now + pen * (moved**2).sum(axis=1) / 2
                # a loss within rounding is not told from the one before
                bad = now > loss + FALL * length * promise + 1e-12 * (np.abs(loss) + size[:, 0])
                if not (bad & (length > 1e-9)).any():
                    break
                length[bad] /= 2
            effects, loss = moved, now
        return effects, p, slope, curves, loss


def _added(layout: Layout, scores, weights, pen: float, goal: float, batches):
    """What the events of a task add: matrix, fitted sums, shift of the slope, loss; yields (level, effects) before."""
    k, pairs = layout.width, layout.pairs
    places = layout.places()
    bends = np.zeros((len(pairs), layout.combinations))
    sums = np.zeros((k, layout.combinations))
    matrix = np.zeros((layout.count * k,) * 2)
    shift, loss, worst = np.zeros(layout.count * k), 0.0, 0.0
    most_rows = max(1, CROSS // (layout.count * k * k))
    for batch in batches:
        for levels, lengths, cells, counts, *_ in _slices(batch, most_rows):
            part = _Slice(layout, scores, weights, lengths, cells, counts)
            there = levels.is_valid().to_numpy(zero_copy_only=False).astype(float)
            effects, p, slope, curves, losses = part.solved(layout, there, pen, goal)
            loss += losses.sum()
            worst = max(worst, (np.abs(slope) / (part.seen.sum(axis=1, keepdims=True) + pen)).max())
            for a in range(k):
                sums[a] += np.bincount(part.combination, part.t * p[a], layout.combinations)
            rows = len(lengths)
            cross = np.empty((len(pairs), rows, layout.count))
            codes = [part.row * (size + 1) + place[part.combination] for size, place in zip(layout.sizes, places)]
            for i, bend in enumerate(part.bend(p, pairs)):
                bends[i] += np.bincount(part.combination, bend, layout.combinations)
                for at, size, code in zip(layout.starts, layout.sizes, codes):
                    cross[i, :, at : at + size] = np.bincount(code, bend, rows * (size + 1)).reshape(rows, -1)[:, :size]
                cross[i, :, -1] = part.sums(bend)
            # (row, class, place and class), nothing for rows without a level
            cross = layout.square(cross).transpose(2, 0, 3, 1).reshape(rows, k, -1) * there[:, None, None]
            turned = np.linalg.solve(curves, cross)
            matrix -= cross.reshape(rows * k, -1).T @ turned.reshape(rows * k, -1)
            shift -= np.einsum("rkp,rk->p", turned, slope)
            yield levels, effects
    matrix += layout.curvature(bends)
    return matrix, layout.by_level(sums), shift, loss, worst


STEP = "part int, level string, v array<double>"


def _step(layout: Layout, b, weights, pen: float, goal: float):
    """Tasks of a step: effects of large levels, then the parts of the system by number."""

    def record(numbers, levels, values):
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32())
        values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values), pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), levels, values], ["part", "level", "v"])

    def run(batches):
        work = _added(layout, layout.scores(b), weights, pen, goal, batches)
        while True:
            try:
                levels, effects = next(work)
            except StopIteration as end:
                matrix, sums, shift, loss, worst = end.value
                break
            yield record([None] * len(levels), levels.cast(pa.string()), list(effects))
        values = [*matrix, sums.ravel(), shift, np.array([loss]), np.array([worst])]
        yield record(range(len(values)), pa.nulls(len(values), pa.string()), values)

    return run


def _totalled(worst: int):
    """Sums of the parts by number; the ``worst`` one is the largest instead."""

    def run(batches):
        found = {}
        for batch in batches:
            for number, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = values.values.to_numpy()
                if number not in found:
                    found[number] = values.copy()
                elif number == worst:
                    np.maximum(found[number], values, out=found[number])
                else:
                    found[number] += values
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))],
                ["part", "v"],
            )

    return run


class _Point(NamedTuple):
    """Effects ``b`` of the small levels, what is known there, and the stored step with the large levels' effects."""

    b: np.ndarray
    matrix: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    loss: float
    worst: float
    step: DataFrame | None


def _found(made: Packed, weights: np.ndarray, pen: float, b: np.ndarray, parts, step=None) -> _Point:
    layout = made.layout
    matrix, sums, shift, loss, worst = parts
    seen = layout.by_level((made.totals * weights).T)
    pens = np.full((layout.count, 1), pen)
    pens[-1] = 0.0
    slope = sums - seen + pens * b
    matrix = matrix + np.diag(np.repeat(pens[:, 0], layout.width))
    # all intercepts can rise together without a change
    matrix[-layout.width :, -layout.width :] += seen[-1].sum() / layout.width
    steep = np.abs(slope) / (seen.sum(axis=1, keepdims=True) + pens)
    return _Point(
        b, matrix, slope.ravel(), shift, float(loss) + float((pens * b**2).sum()) / 2,
        max(float(worst), float(steep.max())), step,
    )


def _newton(start: np.ndarray, evaluate, tol: float) -> _Point:
    here, progress = evaluate(start), _Progress("multinomial", tol)
    while here.worst > tol:
        step = -np.linalg.solve(here.matrix, here.slope + here.shift)
        slope, length = float(here.slope @ step), 1.0
        while True:
            trial = evaluate(here.b + length * step.reshape(here.b.shape))
            progress.note(trial.worst)
            if trial.worst <= tol or trial.loss <= here.loss + FALL * length * slope + 1e-11 * abs(here.loss):
                break
            _dropped(trial)
            length /= 2
        _dropped(here)
        here = trial
    return here


def _dropped(point: _Point) -> None:
    if point.step is not None:
        discard(point.step)


def _of_classes(made: Packed, weights: DataFrame | None) -> np.ndarray:
    if weights is None:
        return np.ones(len(made.classes))
    # one row per outcome class
    found = dict(weights.select("event", "w").collect())
    return np.array([found.get(e) or 0.0 for e in made.classes])


def fit(
    made: Packed, weights: DataFrame | None = None, c: float = 1.0, tol: float = 1e-7
) -> tuple[DataFrame, DataFrame]:
    """Effects (split, level, one column per class) and intercepts (event, b) of ``packed`` events.

    Minimises the weighted log loss plus |effects|^2 / (2 c) by Newton steps, until no level's
    slope is above ``tol`` times its weight and penalty; ``NotConverged`` if steps stop helping.
    They start from the same model without the large split, which needs only the totals. A step
    is a scan of the packed rows: a task solves for its large levels, takes them out of the
    system and hands on one matrix of the small levels; the sum of these reaches the driver.
    """
    layout, pen, spark = made.layout, 1.0 / c, made.rows.sparkSession
    worths = _of_classes(made, weights)
    seen = (made.totals * worths).sum(axis=0)
    if not (seen > 0).all():
        raise NotConverged("multinomial: a class without weight has no finite intercept")

    def without(b: np.ndarray) -> _Point:
        cells = np.flatnonzero(made.totals)
        row = pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.array([cells], pa.list_(pa.int32())),
             pa.array([made.totals.ravel()[cells].astype(np.int64)], pa.list_(pa.int64()))],
            ["level", "cells", "counts"],
        )
        work = _added(layout, layout.scores(b), worths, pen, tol, [row])
        while True:
            try:
                next(work)
            except StopIteration as end:
                return _found(made, worths, pen, b, end.value)

    size = layout.count * layout.width

    def evaluate(b: np.ndarray) -> _Point:
        step = written(_in_batches(made.rows, _step(layout, b, worths, pen, CLOSER * tol), STEP), "step")
        parts = step.filter(F.col("part").isNotNull()).select("part", "v").repartition("part")
        parts = dict(_in_batches(parts, _totalled(size + 3), "part int, v array<double>").collect())
        matrix = np.array([parts[i] for i in range(size)])
        sums = np.array(parts[size]).reshape(layout.count, -1)
        rest = np.array(parts[size + 1]), parts[size + 2][0], parts[size + 3][0]
        return _found(made, worths, pen, b, (matrix, sums, *rest), step)

    start = np.zeros((layout.count, layout.width))
    start[-1] = np.log(seen / seen.sum())
    best = _newton(_newton(start, without, tol).b, evaluate, tol)
    kinds = ", ".join(f"`{e}` double" for e in made.classes)
    rows = [(*label, *map(float, b)) for label, b in zip(made.labels[:-1], best.b)]
    small = spark.createDataFrame(rows, f"split string, level string, {kinds}")
    large = best.step.filter(F.col("part").isNull() & F.col("level").isNotNull()).select(
        F.lit(made.large).alias("split"), "level", *[F.col("v")[k].alias(e) for k, e in enumerate(made.classes)]
    )
    effects = written(large.union(small), "effects")
    _dropped(best)
    bases = best.b[-1] - best.b[-1].mean()
    return effects, spark.createDataFrame([*zip(made.classes, map(float, bases))], "event string, b double")


def residuals(
    made: Packed, effects: DataFrame, intercepts: DataFrame, weights: DataFrame | None = None
) -> DataFrame:
    """(split, level, n, one column per class): weighted observed less fitted class totals of a level."""
    layout, classes = made.layout, made.classes
    worths, labels = _of_classes(made, weights), made.labels[:-1]
    # at most DENSE coefficients, and one row per outcome class
    known = {tuple(row[:2]): row[2:] for row in effects.filter(F.col("split") != made.large).select(*KEYS, *classes).collect()}
    bases = dict(intercepts.collect())
    none = [0.0] * len(classes)
    b = np.array([*[known.get(label, none) for label in labels], [bases[e] for e in classes]], dtype=float)
    lookup = effects.filter(F.col("split") == made.large).select("level", F.array(*classes).alias("b"))
    large = made.large

    def record(splits, levels, n, sums):
        values = [pa.array(np.ascontiguousarray(column), pa.float64()) for column in sums.T]
        kept = [pa.array(splits, pa.string()), levels, pa.array(n.astype(np.int64)), *values]
        return pa.RecordBatch.from_arrays(kept, ["split", "level", "n", *classes])

    def run(batches):
        scores = layout.scores(b)
        cells = np.zeros((len(classes) + 1, layout.combinations))
        for batch in batches:
            own = batch.column(3)
            for levels, lengths, codes, counts, at, to in _slices(batch, SLICE):
                part = _Slice(layout, scores, worths, lengths, codes, counts)
                mine = own.slice(at, to - at)
                held = mine.is_valid().to_numpy(zero_copy_only=False)
                effect = np.zeros((to - at, len(classes)))
                effect[held] = mine.flatten().to_numpy().reshape(-1, len(classes))
                p, _ = part.shares(effect)
                rest = -part.t * p
                rest[part.cls, np.arange(len(part.cls))] += part.t
                for a, row in enumerate([counts, *rest]):
                    cells[a] += np.bincount(part.combination, row, layout.combinations)
                yield record([large] * (to - at), levels.cast(pa.string()), part.sums(counts), part.sums(rest))
        sums = layout.by_level(cells)[:-1]
        yield record([s for s, _ in labels], pa.array([x for _, x in labels], pa.string()), sums[:, 0], sums[:, 1:])

    rows = made.rows.join(lookup, "level", "left").select("level", "cells", "counts", "b")
    kinds = ", ".join(f"`{e}` double" for e in classes)
    found = _in_batches(rows, run, f"split string, level string, n bigint, {kinds}").filter(F.col("level").isNotNull())
    return found.groupBy(*KEYS).agg(F.sum("n").alias("n"), *[F.sum(e).alias(e) for e in classes])
