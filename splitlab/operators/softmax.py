"""Multinomial logistic regression on a table of level combinations.

Events with equal levels are one row that carries a weight per class. Effects,
gradients and the quasi-Newton history are arrays in one table with a row per
level, and the intercepts are its row ``total``. The driver sees inner products
only, so the number of levels is bounded by storage, not by one machine.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.operators.lookups import is_small
from splitlab.operators.rates import TOTAL, by_each_split
from splitlab.operators.solvers import KEYS, _numbers, _Progress, inner_products
from splitlab.session import discard, written

#: Pairs of steps and gradient changes that shape the next direction.
HISTORY = 8
#: A step is shortened until the loss falls by this share of what its slope promises.
FALL = 1e-4

ADD, LESS = "(p, q) -> p + q", "(p, q) -> p - q"


def combinations(events: DataFrame, splits, weights: DataFrame | None = None):
    """(splits, y) with ``y`` the weight of each class, and the sorted classes, out of ``design.equal_events``.

    One row per combination of levels; a missing level is null and has no effect.
    """
    # one row per outcome class
    classes = sorted(row[0] for row in events.select("event").distinct().collect())
    weight = F.col("n").cast("double")
    if weights is not None:
        # one row per outcome class
        events = events.join(F.broadcast(weights.select("event", "w")), "event")
        weight = weight * F.col("w")
    sums = [F.sum(F.when(F.col("event") == c, weight).otherwise(0.0)) for c in classes]
    return events.groupBy(*splits).agg(F.array(*sums).alias("y")), classes


def _scores(rows: DataFrame, effects: DataFrame, splits, width: int, small: set) -> DataFrame:
    """``rows`` with the scores ``_s0``, ``_s1``, ...: the intercepts plus the effects of the row's levels."""
    parts = [effects.filter(F.col("split") == TOTAL).select("b").scalar()]
    for split in splits:
        lookup = effects.filter(F.col("split") == split)
        lookup = lookup.select(F.col("level").alias(split), F.col("b").alias(f"_b_{split}"))
        rows = rows.join(F.broadcast(lookup) if split in small else lookup, split, "left")
        parts.append(F.col(f"_b_{split}"))
    scores = {
        f"_s{k}": sum((F.coalesce(part[k], F.lit(0.0)) for part in parts[1:]), parts[0][k])
        for k in range(width)
    }
    return rows.select(*splits, "y", *[score.alias(name) for name, score in scores.items()])


def _slopes(rows: DataFrame, effects: DataFrame, splits, width: int, small: set) -> DataFrame:
    """(split, level, g, loss): fitted less observed class weights and the loss, by level and in all."""
    scored = _scores(rows, effects, splits, width, small)
    names = [f"_s{k}" for k in range(width)]
    top = F.greatest(*names) if width > 1 else F.col(names[0])
    scored = scored.withColumn("_top", top)
    scored = scored.withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - F.col("_top")) for k in range(width)})
    y = [F.col("y")[k] for k in range(width)]
    scored = scored.withColumns(
        {"_t": sum(y[1:], y[0]), "_sum": sum((F.col(f"_e{k}") for k in range(1, width)), F.col("_e0"))}
    )
    seen = sum((y[k] * (F.col(names[k]) - F.col("_top")) for k in range(width)), F.lit(0.0))
    rest = [
        (F.col("_t") * F.col(f"_e{k}") / F.col("_sum") - y[k]).alias(f"_g{k}") for k in range(width)
    ]
    cells = scored.select(*splits, (F.col("_t") * F.log("_sum") - seen).alias("loss"), *rest)
    sums = [F.array(*[F.sum(f"_g{k}") for k in range(width)]).alias("g"), F.sum("loss").alias("loss")]
    return by_each_split(cells, splits, sums, with_total=True)


def _mixed(vectors: str, factors, width: int) -> str:
    """The sum of the vectors in an array of vectors, each times its factor."""
    return (
        f"aggregate(zip_with({vectors}, {_numbers(factors)}, (u, f) -> transform(u, e -> e * f)), "
        f"{_numbers([0.0] * width)}, (a, u) -> zip_with(a, u, {ADD}))"
    )


def _direction(inner, sums, between, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """The quasi-Newton direction: factors of (point, slope, step 1, change 1, ...), and shifts.

    The two-loop recursion carried out on inner products. The first guess of the inverse
    curvature is the identity plus ``between``, which acts on the ``sums`` of a vector
    over the levels of each split and answers with a shift (split, class).
    """

    def guess(factors):
        return np.einsum("kst,tk->sk", between, np.tensordot(factors, sums, 1))

    def times(factors, shift, at):
        return factors @ inner[:, at] + (shift * sums[at]).sum()

    none = np.zeros_like(sums[0])
    factors = np.zeros(len(inner))
    factors[1] = -1.0
    kept = [(2 + 2 * i, 3 + 2 * i) for i in range(pairs)]
    kept = [(s, y) for s, y in kept if inner[s, y] > 1e-14 * np.sqrt(inner[s, s] * inner[y, y])]
    turns = {}
    for s, y in kept:  # newest first
        turns[s] = times(factors, none, s) / inner[s, y]
        factors[y] -= turns[s]
    shift = guess(factors)
    if kept:
        s, y = kept[0]
        change = np.eye(len(inner))[y]
        scale = inner[s, y] / times(change, guess(change), y)
        factors, shift = factors * scale, shift * scale
    for s, y in reversed(kept):
        factors[s] += turns[s] - times(factors, shift, y) / inner[s, y]
    return factors, shift


def _rotated(matrix: np.ndarray, vector: str) -> str:
    rows = ", ".join(_numbers(row) for row in matrix)
    return f"transform(array({rows}), w -> aggregate(zip_with(w, {vector}, (p, q) -> p * q), 0D, {ADD}))"


def _weights_between(rows: DataFrame, splits, width: int) -> np.ndarray:
    """Weight of the events that have a level in both of two splits; the last one is ``total``."""
    total = sum((F.col("y")[k] for k in range(1, width)), F.col("y")[0])
    there = [*[F.col(s).isNotNull().cast("double") for s in splits], F.lit(1.0)]
    cells = [F.sum(total * a * b) for a in there for b in there]
    return np.array(rows.agg(*cells).first(), dtype=float).reshape(len(there), len(there))


def fit(
    events: DataFrame, splits, weights: DataFrame | None = None, c: float = 1.0, tol: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """Effects (split, level, one column per class) and intercepts (event, b), out of ``design.equal_events``.

    Minimises the weighted log loss plus |effects|^2 / (2 c) until no level's slope
    is above ``tol`` times its weight and penalty; ``NotConverged`` if steps stop
    helping. Limited-memory quasi-Newton steps in coordinates in which the curvature of
    a level at the start is the identity; shifts of whole splits against each other, which
    only the penalty tells apart, are solved for with one number per split and class.
    A step is a scan of the combinations, with one lookup per split that is broadcast only
    if it measures small, and an aggregate by level. Combinations stay dealt and sorted by
    the first split that is not small, so that per step only its effects move.
    """
    splits = list(splits)
    rows, classes = combinations(events, splits, weights)
    width = len(classes)
    if not width:
        none = rows.sparkSession.createDataFrame([], "split string, level string")
        return none, rows.sparkSession.createDataFrame([], "event string, b double")
    rows = stored = written(rows, "combinations")
    totals = [F.array(*[F.sum(F.col("y")[k]) for k in range(width)]).alias("y")]
    levels = written(by_each_split(rows, splits, totals, with_total=True), "levels")
    names = [*splits, TOTAL]
    # the row of intercepts
    seen = np.array(levels.filter(F.col("split") == TOTAL).first()["y"], dtype=float)
    share = np.maximum(seen / seen.sum(), 1e-12)
    curves, turn = np.linalg.eigh(np.diag(share) - np.outer(share, share))
    curves = np.maximum(curves, 0.0)
    found = dict(levels.groupBy("split").count().collect())
    penalties = np.array([found.get(name, 0) / c if name != TOTAL else 0.0 for name in names])
    weight = _weights_between(rows, splits, width)
    between = np.array([
        np.linalg.pinv(curve * weight + np.diag(penalties), rcond=1e-10, hermitian=True)
        for curve in curves
    ])
    zeros, blank = _numbers([0.0] * width), 2 * HISTORY
    state = levels.selectExpr(
        *KEYS,
        f"IF(split = '{TOTAL}', 0D, {1.0 / c!r}D) AS pen",
        "aggregate(y, 0D, (a, v) -> a + v) AS t",
        f"IF(split = '{TOTAL}', {_numbers(turn.T @ np.log(share))}, {zeros}) AS b",
    ).selectExpr(
        *KEYS, "pen", "t", "b",
        f"transform({_numbers(curves)}, u -> sqrt(greatest(u * t + pen, 1e-6D * t))) AS s",
    ).selectExpr(
        *KEYS, "pen", "t", "s", "zip_with(b, s, (p, q) -> p * q) AS x",
        f"array_repeat({zeros}, {blank}) AS v",
    )
    sizes = state.select(*KEYS, *[F.lit(0.0).alias(f"_{k}") for k in range(width)])
    small = {split for split in splits if is_small(sizes.filter(F.col("split") == split))}
    large = [split for split in splits if split not in small]
    if large:
        rows = rows.repartition(large[0]).sortWithinPartitions(large[0])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def evaluated(points: DataFrame) -> DataFrame:
        """``points`` (split, level, pen, t, s, x, v) with effects ``b``, slope ``g`` and loss."""
        points = points.withColumn("b", F.expr(_rotated(turn, "zip_with(x, s, (p, q) -> p / q)")))
        slopes = _slopes(rows, points.select(*KEYS, "b"), splits, width, small)
        slope = _rotated(turn.T, "zip_with(g, b, (p, q) -> p + q * pen)")
        return points.join(slopes, KEYS).selectExpr(
            *KEYS, "pen", "t", "s", "x", "b", "loss", "v",
            f"zip_with({slope}, s, (p, q) -> p / q) AS g",
        )

    def measured(state: DataFrame):
        """Inner products of ``v``, sums of the slope by split, loss with penalty, worst slope."""
        penalty = "pen * aggregate(b, 0D, (a, u) -> a + u * u) / 2"
        steep = _rotated(turn, "zip_with(v[1], s, (p, q) -> p * q)")
        cells = [F.sum(F.col("v")[1][k] * F.col("s")[k]) for k in range(width)]
        by_split = state.groupBy("split").agg(
            F.sum(F.expr(f"IF(split = '{TOTAL}', loss, {penalty})")),
            F.max(F.expr(f"array_max(transform({steep}, u -> abs(u))) / (t + pen)")),
            *cells,
        )
        cells = {row[0]: row[1:] for row in by_split.collect()}
        table = np.array([cells.get(name, [0.0] * (width + 2)) for name in names], dtype=float)
        return inner_products(state, "v"), table[:, 2:], table[:, 0].sum(), table[:, 1].max()

    state = evaluated(state).withColumn("v", F.expr("concat(array(x, g), v)")).drop("x", "g")
    state = written(state, "softmax")
    discard(levels)
    inner, steep, loss, worst = measured(state)
    sums = np.zeros((2 + blank, *steep.shape))
    sums[1] = steep
    pairs, progress = 0, _Progress("multinomial", tol)
    while worst > tol:
        factors, shift = _direction(inner, sums, between, pairs)
        slope = float(factors @ inner[:, 1] + (shift * sums[1]).sum())
        length = 1.0 if pairs else 1.0 / len(names)
        while True:
            places = ", ".join(f"'{name}', {_numbers(row)}" for name, row in zip(names, length * shift))
            moved = f"zip_with(v[0], {_mixed('v', length * factors, width)}, {ADD})"
            pushed = f"zip_with(map({places})[split], s, (p, q) -> p * q)"
            points = state.selectExpr(*KEYS, "pen", "t", "s", f"zip_with({moved}, {pushed}, {ADD}) AS x", "v")
            trial = evaluated(points).selectExpr(
                *KEYS, "pen", "t", "s", "b", "loss",
                f"concat(array(x, g, zip_with(x, v[0], {LESS}), zip_with(g, v[1], {LESS})), slice(v, 3, {blank - 2})) AS v",
            )
            trial = written(trial, "softmax")
            made, steep, now, worst = measured(trial)
            progress.note(worst)
            # the slope along the step at its end; losses within rounding are told apart by it
            end = made[1, 2] / length
            if end <= 0 or now <= loss + FALL * length * slope:
                break
            if now <= loss + 1e-11 * abs(loss) and end <= -0.9 * slope:
                break
            discard(trial)
            length *= min(max(slope / (slope - end), 0.1), 0.7)
        discard(state)
        sums = np.concatenate([[sums[0], steep, sums[0], steep - sums[1]], sums[2 : blank]])
        state, inner, loss, pairs = trial, made, now, min(pairs + 1, HISTORY)
    rows.unpersist()
    made = state.select(*KEYS, *[F.col("b")[k].alias(e) for k, e in enumerate(classes)])
    effects = written(made.filter(F.col("split") != TOTAL), "effects")
    intercepts = made.filter(F.col("split") == TOTAL).unpivot(["split"], classes, "event", "b")
    intercepts = written(intercepts.select("event", "b"), "intercepts")
    discard(state, stored)
    return effects, intercepts
