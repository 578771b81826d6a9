"""Linear systems on a distributed X'X table.

Vectors are tables keyed by (split, level); several right-hand sides are solved
together. A step is one join and one aggregate; only the inner
products of the columns reach the driver. Each step's vectors are written to
the shared work folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.session import discard, written

KEYS = ["split", "level"]
#: Steps without a smaller residual after which a solver gives up.
PATIENCE = 60
#: Active cells of X'X (about 100 bytes each) up to which one task solves a lasso column.
ACTIVE_CELLS = 2_000_000
#: Levels outside the largest split (about 100 bytes each) up to which a product broadcasts their vectors.
BROADCAST_LEVELS = 50_000


class NotConverged(ArithmeticError):
    """A solver stopped making progress before it reached its tolerance."""


class _Progress:
    """Raises when the residual has not fallen for ``PATIENCE`` steps; there is no other bound on steps."""

    def __init__(self, what: str, goal: float):
        self.what, self.goal, self.best, self.idle = what, goal, float("inf"), 0

    def note(self, residual: float) -> None:
        if residual < self.best:
            self.best, self.idle = residual, 0
            return
        self.idle += 1
        if self.idle >= PATIENCE or residual != residual:
            raise NotConverged(f"{self.what}: residual {self.best:.3g} reached, {self.goal:.3g} asked for")


def prepared(gram: DataFrame, by=()) -> DataFrame:
    """The X'X table laid out once for repeated products; ``by`` are the keys of separate systems.

    Kept partitioned and sorted by the joined side, so that per step only the
    vector moves; a lost block is rebuilt from the written table. Without ``by``
    ``halved`` keeps a half of it, and ``released`` gives that up.
    """
    table = written(gram, "gram")
    if not by:
        return halved(table)
    joined = [*by, "split2", "level2"]
    return (
        table.repartition(*joined)
        .sortWithinPartitions(*joined)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )


def halved(table: DataFrame) -> DataFrame:
    """The written X'X ``table``, with each pair of levels kept once for ``product``.

    A pair is kept with the level of the larger split, where all pairs of that level lie together: sums
    over them need no shuffle, and sums over the levels of smaller splits shrink in each task.
    """
    sizes = table.filter(F.col("split") == F.col("split2")).groupBy("split").count().collect()
    sizes = sorted((-row["count"], row["split"]) for row in sizes)
    if not sizes:
        return table
    place = F.create_map(*[F.lit(x) for i, (_, split) in enumerate(sizes) for x in (split, i)])
    half = table.filter(place[F.col("split")] <= place[F.col("split2")])
    half = half.repartition(*KEYS).sortWithinPartitions(*KEYS)
    table.half = half.persist(StorageLevel.MEMORY_AND_DISK)
    table.largest, table.others = sizes[0][1], -sum(n for n, _ in sizes[1:])
    return table


def released(gram: DataFrame) -> None:
    """Frees what ``prepared`` keeps; the written table stays readable."""
    gram.__dict__.get("half", gram).unpersist()


def product(gram: DataFrame, vectors: DataFrame, name: str, width: int, by=()) -> DataFrame:
    """X'X times each column of the array column ``name``; with ``by`` keys, system by system."""
    right = vectors.selectExpr(*by, "split AS split2", "level AS level2", f"{name} AS _v")
    sums = [f"sum(n * _v[{i}])" for i in range(width)]
    made = F.expr(f"array({', '.join(sums)})").alias(name)
    half = gram.__dict__.get("half")
    if half is None:
        return gram.join(right, [*by, "split2", "level2"]).groupBy(*by, *KEYS).agg(made)
    # pairs of two splits for the larger one's levels; all pairs, the diagonal too, for the smaller one's
    right = right.filter(F.col("split2") != gram.largest)
    if gram.others <= BROADCAST_LEVELS:
        right = F.broadcast(right)
    larger = half.filter(F.col("split") != F.col("split2")).join(right, ["split2", "level2"])
    larger = larger.groupBy(*KEYS).agg(made)
    smaller = half.join(vectors.select(*KEYS, F.col(name).alias("_v")), KEYS).groupBy("split2", "level2").agg(made)
    sums = [f"sum({name}[{i}])" for i in range(width)]
    both = larger.union(smaller.select("split2", "level2", name))
    return both.groupBy(*KEYS).agg(F.expr(f"array({', '.join(sums)})").alias(name))


def column_product(gram: DataFrame, vectors: DataFrame, columns) -> DataFrame:
    """X'X times each of several vector columns."""
    packed = vectors.select(*KEYS, F.array(*columns).alias("v"))
    image = product(gram, packed, "v", len(columns))
    return image.select(*KEYS, *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def scaled(gram: DataFrame, rhs: DataFrame, columns, tau: dict[str, float]):
    """Both sides for a design whose columns are multiplied by a factor per split."""
    pairs = ", ".join(f"'{split}', {float(value)!r}D" for split, value in tau.items())

    def factor(split: str):
        return F.coalesce(F.expr(f"map({pairs})")[F.col(split)], F.lit(1.0))

    left = gram.withColumn("n", F.col("n") * factor("split") * factor("split2"))
    right = rhs.withColumns({c: F.col(c) * factor("split") for c in columns})
    return left, right


def _with_diagonal(gram: DataFrame, vectors: DataFrame, alpha: float) -> DataFrame:
    """``vectors`` with ``m``, the diagonal of X'X + alpha I."""
    diagonal = gram.filter(
        (F.col("split") == F.col("split2")) & (F.col("level") == F.col("level2"))
    ).select(*KEYS, (F.col("n") + alpha).alias("m"))
    return vectors.join(diagonal, KEYS)


def _numbers(values) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


PRODUCTS = (
    "d[{0}] * q[{0}]", "r[{0}] * r[{0}] / m", "r[{0}] * q[{0}] / m", "q[{0}] * q[{0}] / m",
    "r[{0}]", "q[{0}]",
)


def _inner(step: DataFrame, names: list[str], width: int) -> np.ndarray:
    """Sums of PRODUCTS by split, in one aggregate: (product, split, column)."""
    sums = [F.expr(f"sum({text.format(i)})") for text in PRODUCTS for i in range(width)]
    found = {row[0]: row[1:] for row in step.groupBy("split").agg(*sums).collect()}
    cells = np.array([found[name] for name in names], dtype=float)
    return cells.reshape(len(names), len(PRODUCTS), width).transpose(1, 0, 2)


def _between_splits(gram: DataFrame, alpha: float) -> tuple[list[str], np.ndarray]:
    """X'X + alpha I summed over the levels of each pair of splits, inverted."""
    rows = gram.groupBy("split", "split2").agg(F.sum("n"), F.countDistinct("level")).collect()
    names = sorted({row[0] for row in rows})
    total = np.zeros((len(names), len(names)))
    for split, split2, n, levels in rows:
        i, j = names.index(split), names.index(split2)
        total[i, j] = n + (alpha * levels if i == j else 0.0)
    return names, np.linalg.pinv(total, rcond=1e-12, hermitian=True)


def conjugate_gradient(
    gram: DataFrame,
    rhs: DataFrame,
    columns,
    alpha: float = 0.0,
    tol: float = 1e-9,
) -> DataFrame:
    """Solve (X'X + alpha I) b = rhs for all columns at once, from b = 0.

    Steps go on until every column's residual has fallen by ``tol``; ``NotConverged``
    is raised when they stop helping.

    Preconditioned in two parts. Residuals are divided by the level counts on
    the diagonal, so that levels seen rarely and often converge alike; and the
    shift of a split as a whole, which one-hot splits hardly tell from that of
    another split, is solved for exactly (one number per split). With alpha = 0
    and a singular X'X the result is one of the solutions.

    The columns ride in one array; step lengths enter as array values, so every
    step runs the code generated for the first one.
    """
    width = len(columns)
    plus, minus = "(u, v) -> u + v", "(u, v) -> u - v"
    names, between = _between_splits(gram, alpha)

    def times(array: str, factors) -> str:
        return f"zip_with({array}, {_numbers(factors)}, (u, f) -> u * f)"

    def direction(shift: np.ndarray) -> str:
        moved = ", ".join(f"'{name}', {_numbers(row)}" for name, row in zip(names, shift))
        return f"zip_with(transform(r, u -> u / m), map({moved})[split], {plus})"

    sides = rhs.select(*KEYS, *columns)
    sums = sides.groupBy("split").agg(*[F.sum(c) for c in columns]).collect()
    found = {row[0]: row[1:] for row in sums}
    shift = between @ np.array([found[name] for name in names], dtype=float)
    state = (
        _with_diagonal(gram, sides, alpha)
        .selectExpr(
            *KEYS, "m", f"{_numbers([0.0] * width)} AS x",
            f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}) AS r",
        )
        .selectExpr("*", f"{direction(shift)} AS d")
    )
    state = last = written(state, "cg")
    start, progress = None, _Progress("conjugate gradient", tol)
    while True:
        image = product(gram, state, "d", width).withColumnRenamed("d", "q")
        step = state.join(image, KEYS, "left").selectExpr(
            *KEYS, "m", "x", "r", "d", f"zip_with(q, {times('d', [alpha] * width)}, {plus}) AS q"
        )
        step = written(step, "cg")
        dq, rr, rq, qq, r1, q1 = _inner(step, names, width)
        dq, rr, rq, qq = (part.sum(axis=0) for part in (dq, rr, rq, qq))
        now = rr + (r1 * (between @ r1)).sum(axis=0)
        start = now if start is None else start
        open_ = now > tol**2 * start
        if (open_ & (dq <= 0)).any():
            raise NotConverged("conjugate gradient: the right-hand side is outside the range of X'X")
        going = open_
        lengths = np.where(going, now / np.where(going, dq, 1.0), 0.0)
        r1 = r1 - lengths * q1
        shift = between @ r1
        left = rr - 2 * lengths * rq + lengths**2 * qq + (r1 * shift).sum(axis=0)
        left = np.maximum(left, 0.0)
        done = not (going & (left > tol**2 * start)).any()
        turns = np.where(going, left / np.where(going, now, 1.0), 0.0)
        state = step.selectExpr(
            *KEYS, "m", "d",
            f"zip_with(x, {times('d', lengths)}, {plus}) AS x",
            f"zip_with(r, {times('q', lengths)}, {minus}) AS r",
        ).selectExpr(
            *KEYS, "m", "x", "r",
            f"zip_with({direction(shift)}, {times('d', turns)}, {plus}) AS d",
        )
        discard(last)  # the new state reads this step's table only
        last = step
        if done:
            break
        scale = np.where(start > 0, start, 1.0)
        progress.note(float(np.sqrt((left / scale).max())))
    return state.selectExpr(*KEYS, *[f"x[{i}] AS {c}" for i, c in enumerate(columns)])


def soft_threshold_descent(
    gram: DataFrame,
    rhs: DataFrame,
    columns,
    penalty: float,
    tol: float = 1e-5,
) -> DataFrame:
    """Minimise b'X'Xb / 2 - b'rhs + penalty |b|_1 for all columns at once.

    Accelerated proximal gradient. A row of the design has one entry per split,
    so X'X is at most (number of splits) times its diagonal, which gives every
    level its own safe step. A column's momentum restarts when it points uphill.
    ``tol`` is the largest subgradient violation left, relative to ``penalty``;
    ``NotConverged`` is raised when steps stop making it smaller.
    """
    width = len(columns)
    splits = rhs.select("split").distinct().count()
    zeros = _numbers([0.0] * width)
    state = _with_diagonal(gram, rhs.select(*KEYS, *columns), 0.0).selectExpr(
        *KEYS, f"m * {splits} AS m", f"{zeros} AS b", f"{zeros} AS y",
        f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}) AS t",
    )
    state = written(state, "prox")
    momentum = [1.0] * width
    shrink = f"u -> signum(u) * greatest(abs(u) - {float(penalty)!r}D / m, 0D)"
    checks = (
        "max(abs(z[{0}] - y[{0}]) * m)",
        "sum(m * (y[{0}] - z[{0}]) * (z[{0}] - b[{0}]))",
    )
    progress, last = _Progress("soft threshold descent", tol * penalty), state
    while True:
        image = product(gram, state, "y", width).withColumnRenamed("y", "q")
        moved = "zip_with(y, zip_with(t, q, (u, v) -> (u - v) / m), (u, v) -> u + v)"
        step = state.join(image, KEYS).selectExpr(
            *KEYS, "m", "b", "y", "t", f"transform({moved}, {shrink}) AS z"
        )
        step = written(step, "prox")
        row = step.agg(
            *[F.expr(text.format(i)) for i in range(width) for text in checks]
        ).first()
        pull, worst = [], 0.0
        for i in range(width):
            gap, uphill = row[2 * i], row[2 * i + 1]
            worst = max(worst, gap)
            before = 1.0 if uphill > 0 else momentum[i]
            momentum[i] = (1 + (1 + 4 * before**2) ** 0.5) / 2
            pull.append((before - 1) / momentum[i])
        drift = f"zip_with(zip_with(z, b, (u, v) -> u - v), {_numbers(pull)}, (u, f) -> u * f)"
        state = step.selectExpr(
            *KEYS, "m", "z AS b", f"zip_with(z, {drift}, (u, v) -> u + v) AS y", "t"
        )
        discard(last)  # the new state reads this step's table only
        last = step
        if worst <= tol * penalty:
            break
        progress.note(worst)
    return state.selectExpr(*KEYS, *[f"b[{i}] AS {c}" for i, c in enumerate(columns)])


def _coordinate_steps(entries, penalty: float, tol: float):
    """Lasso of one column on its active levels, as rows (col, split, level, z).

    ``entries`` are the cells of X'X with the row's right-hand side ``t`` and start ``b``.
    Levels of one split never meet in a row, so a split is solved exactly at a stroke while
    the others stand still; splits take turns until every subgradient is within ``tol``.
    """
    codes, names = entries["split"].str.cat(entries["level"], sep="\x1f").factorize()
    other = names.get_indexer(entries["split2"].str.cat(entries["level2"], sep="\x1f"))
    n = entries["n"].to_numpy(dtype=float)
    m, t, b = (np.zeros(len(names)) for _ in range(3))
    t[codes], b[codes] = entries["t"], entries["b"]
    m[codes[codes == other]] = n[codes == other]
    split, level = zip(*(name.split("\x1f", 1) for name in names))
    split = np.array(split)
    outside = split[codes] != split[other]
    blocks = []
    for name in np.unique(split):
        cells = outside & (split[codes] == name)
        blocks.append((np.flatnonzero(split == name), codes[cells], other[cells], n[cells]))
    progress = _Progress("coordinate steps", tol)
    while True:
        for at, left, right, count in blocks:
            rest = (t - np.bincount(left, count * b[right], len(b)))[at]
            b[at] = np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0.0) / m[at]
        gap = t - np.bincount(codes, n * b[other], len(b))
        bad = np.where(b == 0, np.maximum(np.abs(gap) - penalty, 0.0), np.abs(gap - penalty * np.sign(b)))
        if bad.max() <= tol:
            break
        progress.note(float(bad.max()))
    return pd.DataFrame(
        {
            "col": entries["col"].iloc[0], "split": split, "level": list(level), "z": b,
        }
    )


def active_set_lasso(
    gram: DataFrame, rhs: DataFrame, columns, penalty: float, tol: float = 1e-5
) -> DataFrame:
    """Minimise b'X'Xb / 2 - b'rhs + penalty |b|_1 for all columns, over their active levels only.

    A round checks the subgradient of every level of every column, adds the levels that break
    it to the active ones, and solves each column on its active levels in a task of its own.
    It ends when no level breaks it by more than ``tol`` times ``penalty``. Where a column's
    active cells of X'X are above ``ACTIVE_CELLS`` (counted), ``soft_threshold_descent`` takes
    the active levels of all columns instead; the result has the same optimality.
    """
    width = len(columns)
    zeros = _numbers([0.0] * width)
    state = written(
        rhs.selectExpr(
            *KEYS, f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}) AS t", f"{zeros} AS b"
        ),
        "active",
    )
    progress = _Progress("active sets", tol * penalty)
    cut = f"{float(penalty)!r}D"
    while True:
        image = product(gram, state, "b", width).withColumnRenamed("b", "q")
        checked = state.join(image, KEYS, "left").selectExpr(
            *KEYS, "t", "b", "zip_with(t, q, (u, v) -> u - v) AS gap"
        ).selectExpr(
            *KEYS, "t", "b",
            f"zip_with(b, gap, (u, g) -> IF(u = 0, greatest(abs(g) - {cut}, 0D), abs(g - {cut} * signum(u)))) AS bad",
            f"zip_with(b, gap, (u, g) -> u != 0 OR abs(g) > {cut}) AS act",
        )
        checked = written(checked, "active")
        worst = checked.agg(F.max(F.array_max("bad"))).first()[0]
        if worst is None or worst <= tol * penalty:
            break
        progress.note(worst)
        active = checked.filter(F.exists("act", lambda a: a))
        right = active.select(F.col("split").alias("split2"), F.col("level").alias("level2"), F.col("act").alias("act2"))
        cells = gram.join(active.drop("bad"), KEYS).join(right, ["split2", "level2"])
        cells = cells.selectExpr(
            *KEYS, "split2", "level2", "n",
            "posexplode(zip_with(arrays_zip(t, b), zip_with(act, act2, (u, v) -> u AND v), (s, a) -> IF(a, s, NULL))) AS (col, s)",
        )
        cells = written(cells.filter("s IS NOT NULL").selectExpr("*", "s.t AS t", "s.b AS b").drop("s"), "cells")
        most = cells.groupBy("col").count().agg(F.max("count")).first()[0]
        if most <= ACTIVE_CELLS:
            def solve(entries):
                return _coordinate_steps(entries, penalty, tol * penalty / 2)

            solved = cells.groupBy("col").applyInPandas(solve, "col int, split string, level string, z double")
            picked = [F.sum(F.when(F.col("col") == i, F.col("z"))) for i in range(width)]
            solved = solved.groupBy(*KEYS).agg(
                F.array(*[F.coalesce(x, F.lit(0.0)) for x in picked]).alias("z")
            )
        else:
            inside = active.select(*KEYS)
            both = gram.join(inside, KEYS).join(right.drop("act2"), ["split2", "level2"])
            both, sides = prepared(both), rhs.join(inside, KEYS)
            solved = soft_threshold_descent(both, sides, columns, penalty, tol / 2)
            solved = solved.select(*KEYS, F.array(*columns).alias("z"))
        moved = checked.join(solved, KEYS, "left").selectExpr(*KEYS, "t", f"coalesce(z, {zeros}) AS b")
        last, state = state, written(moved, "active")
        discard(last, checked, cells)
    made = state.selectExpr(*KEYS, *[f"b[{i}] AS {c}" for i, c in enumerate(columns)])
    discard(checked)
    return made


def inner_products(table: DataFrame, name: str) -> np.ndarray:
    """Inner products of the vectors in ``name``, an array of equally long arrays per row.

    Vector i is made of the entries i of all rows. Every task adds the products of its
    rows into one small matrix; the plan is the same for any number of vectors.
    """

    def sums(batches):
        total = None
        for batch in batches:
            rows = batch.column(0)
            if not len(rows):
                continue
            cells = rows.flatten()
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            count = len(cells) // len(rows)
            each = flat.reshape(len(rows), count, len(flat) // max(len(cells), 1))
            each = each.transpose(1, 0, 2).reshape(count, -1)
            total = each @ each.T if total is None else total + each @ each.T
        if total is not None:
            at = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(at, len(at))), pa.array(np.tile(at, len(at))),
                    pa.array(total.ravel()),
                ],
                ["i", "j", "p"],
            )

    parts = table.select(name).mapInArrow(sums, "i int, j int, p double")
    found = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    size = int(found["i"].max()) + 1 if len(found) else 0
    made = np.zeros((size, size))
    made[found["i"], found["j"]] = found["p"]
    return made


def least_norm(
    gram: DataFrame, rhs: DataFrame, columns, probes: int = 8, tol: float = 1e-6
) -> tuple[DataFrame, int]:
    """The solution of X'X b = rhs with least norm, and the nullity of X'X.

    Random vectors z are solved for along with the right-hand sides: z less any
    solution of X'X b = X'X z lies in the null space, and such vectors span it
    once there are more of them than the nullity. Taking their span out of any
    solution leaves the one of least norm.
    """
    names = [f"z{i}" for i in range(probes)]
    noise = {c: F.xxhash64("split", "level", F.lit(i)) / float(2**63) for i, c in enumerate(names)}
    sides = rhs.select(*KEYS, *columns).withColumns(noise)
    sides = written(sides, "probes")
    both = sides.select(*KEYS, *columns).join(column_product(gram, sides, names), KEYS)
    solved = conjugate_gradient(gram, both, [*columns, *names])
    solved = solved.withColumnsRenamed({c: f"s_{c}" for c in names})
    table = written(
        sides.select(*KEYS, *names)
        .join(solved, KEYS)
        .withColumns({c: F.col(c) - F.col(f"s_{c}") for c in names}),
        "null",
    )
    packed = table.select(F.transform(F.array(*names, *columns), lambda u: F.array(u)).alias("v"))
    inner = inner_products(packed, "v")
    values, vectors = np.linalg.eigh(inner[:probes, :probes])
    found = values > tol
    nullity = int(found.sum())
    if nullity == probes and table.count() > probes:
        return least_norm(gram, rhs, columns, probes * 2, tol)
    if not columns or not nullity:
        return table.select(*KEYS, *columns), nullity
    basis = vectors[:, found] / values[found]
    weights = basis @ (vectors[:, found].T @ inner[:probes, probes:])
    span = F.array(*names)
    moved = [
        f"{c} - aggregate(zip_with(_span, {_numbers(weights[:, j])}, (u, w) -> u * w), 0D, (a, u) -> a + u) AS {c}"
        for j, c in enumerate(columns)
    ]
    return table.withColumn("_span", span).selectExpr(*KEYS, *moved), nullity


def gram_rank(gram: DataFrame) -> DataFrame:
    """Size and rank of X'X: (p, rank)."""
    table = prepared(gram)
    levels = written(table.select(*KEYS).distinct(), "levels")
    p = levels.count()
    _, nullity = least_norm(table, levels, [])
    released(table)
    return gram.sparkSession.createDataFrame([(p, p - nullity)], "p bigint, rank bigint")
