"""Effect models of many seasons at once: every season is a system of its own, solved in one run.

Tables carry the season as one more key. The solver keeps no number of any system in the driver or in a plan: step
lengths, shifts and residuals are rows of a table keyed by (season, split) that the vectors are joined with, and a season
whose residual has fallen far enough leaves the run. The driver sees how many are open and the worst residual.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlab.functions import metrics
from splitlab.functions.odds import CLAMPS, inverse_logit, logit
from splitlab.functions.outcomes import OUTCOMES, not_other
from splitlab.operators import design
from splitlab.operators.plate import MODEL_SPLITS
from splitlab.operators.rates import TOTAL, by_each_split, class_counts
from splitlab.operators.solvers import KEYS, PRODUCTS, NotConverged, _Progress, prepared, product
from splitlab.session import discard, written

SEASON = "season"


def season_counts(plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """``design.level_counts`` of every season; events without a season are in none."""
    sums = [F.count("event").alias("PA"), F.count(F.lit(1)).alias("n"), *class_counts()[1:]]
    kept = plate.filter(not_other() & F.col(SEASON).isNotNull())
    return by_each_split(kept, splits, sums, [SEASON], with_total=True)


def season_means(counts: DataFrame) -> DataFrame:
    """(season, m_<outcome>): mean shares of every season."""
    total = counts.filter(F.col("split") == TOTAL)
    return total.select(SEASON, *[F.try_divide(F.col(e), F.col("PA")).alias(f"m_{e}") for e in OUTCOMES])


def season_xty(counts: DataFrame, space: str = "share", clamp_pair=CLAMPS["narrow"]) -> DataFrame:
    """X'y of every season as (season, split, level, n, one column per outcome)."""
    design.check_space(space)
    n = F.col("n")
    if space == "share":
        sums = {e: F.col(e) - n * F.col(f"m_{e}") for e in OUTCOMES}
    else:
        high, low = (logit(F.lit(value)) for value in clamp_pair)
        sums = {e: F.col(e) * high + (n - F.col(e)) * low - n * logit(F.col(f"m_{e}")) for e in OUTCOMES}
    rows = counts.filter(F.col("split") != TOTAL).join(season_means(counts), SEASON)
    return rows.select(SEASON, *KEYS, "n", *[c.alias(e) for e, c in sums.items()])


def shrunken_by_season(counts: DataFrame, alpha: float, space: str = "share") -> DataFrame:
    """Ridge for each split and season on its own, in closed form from ``season_counts``."""
    sums = season_xty(counts, space)
    return sums.select(SEASON, *KEYS, *[(F.col(e) / (F.col("n") + alpha)).alias(e) for e in OUTCOMES])


def ridge_by_season(
    plate: DataFrame, alpha: float, splits=MODEL_SPLITS, space: str = "share", clamp_pair=CLAMPS["narrow"]
) -> DataFrame:
    """(season, split, level, outcomes): ``regress.ridge`` of each season's events, all seasons in one run."""
    counts = written(season_counts(plate, splits), "counts")
    seasons = plate.filter(F.col(SEASON).isNotNull())
    left = prepared(design.gram(seasons, splits, [SEASON]), [SEASON])
    effects = conjugate_gradient_by(left, season_xty(counts, space, clamp_pair), OUTCOMES, SEASON, alpha)
    effects = written(effects, "effects")
    left.unpersist()
    discard(counts)
    return effects


def probabilities_by_season(effects: DataFrame, counts: DataFrame, space: str = "share") -> DataFrame:
    """Effects on top of their season's mean shares."""
    design.check_space(space)
    rows = effects.join(season_means(counts), SEASON)
    if space == "share":
        made = [F.col(e) + F.col(f"m_{e}") for e in OUTCOMES]
    else:
        made = [inverse_logit(F.col(e) + logit(F.col(f"m_{e}"))) for e in OUTCOMES]
    return rows.select(SEASON, *KEYS, *[c.alias(e) for e, c in zip(OUTCOMES, made, strict=True)])


def season_board(estimates: DataFrame, counts: DataFrame, constants: DataFrame, split: str) -> DataFrame:
    """Estimates of one split with PA and metrics by the weights of the row's own season; NULL without weights."""
    own = constants.select(F.col("Season").alias(SEASON), *metrics.SEASON_WEIGHTS)
    seen = counts.select(SEASON, *KEYS, "PA")
    rows = estimates.filter(F.col("split") == split).join(seen, [SEASON, *KEYS]).join(own, SEASON, "left")
    rows = rows.withColumns(metrics.weighted_metrics())
    return rows.select(SEASON, F.col("level").alias(split), "PA", *OUTCOMES, *metrics.weighted_metrics())


def top_of_season(board: DataFrame, metric: str, k: int, ties: list[str], ascending: bool = False) -> DataFrame:
    """The first ``k`` rows of every season with their place, from 1; NULL metrics come last."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(SEASON).orderBy(order, *ties))
    return board.withColumn("place", place).filter(F.col("place") <= k)


def _coarse(gram: DataFrame, by: str, alpha: float) -> DataFrame:
    """(by, split, place, inverse): rows of the inverse of X'X + alpha I summed over the levels of pairs of splits."""

    def inverted(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["split"]))
        total = np.zeros((len(names), len(names)))
        for split, split2, n, levels in zip(rows["split"], rows["split2"], rows["n"], rows["levels"], strict=True):
            i, j = names.index(split), names.index(split2)
            total[i, j] = n + (alpha * levels if i == j else 0.0)
        inverse = np.linalg.pinv(total, rcond=1e-12, hermitian=True)
        return pd.DataFrame({by: rows[by].iloc[0], "split": names, "place": range(len(names)), "inverse": list(inverse)})

    kind = gram.schema[by].dataType.simpleString()
    totals = gram.groupBy(by, "split", "split2").agg(F.sum("n").cast("double").alias("n"), F.countDistinct("level").alias("levels"))
    return totals.groupBy(by).applyInPandas(inverted, f"{by} {kind}, split string, place int, inverse array<double>")


def conjugate_gradient_by(gram: DataFrame, rhs: DataFrame, columns, by: str, alpha: float = 0.0, tol: float = 1e-9) -> DataFrame:
    """``solvers.conjugate_gradient`` for the separate systems of each value of ``by``, with the same two-part preconditioner.

    A system ends when the residuals of all its columns have fallen by ``tol``. ``NotConverged`` is raised when no open
    system gets better any more. Rows without a ``by`` key belong to no system.
    """
    width, keys = len(columns), [by, *KEYS]
    kind = gram.schema[by].dataType.simpleString()
    numbers = f"{by} {kind}, split string"
    coarse = written(_coarse(gram, by, alpha), "coarse")
    plus = "(u, v) -> u + v"

    def zipped(a: str, b: str, f: str) -> str:
        return f"zip_with({a}, {b}, {f})"

    def direction(shift: str) -> str:
        return zipped("transform(r, u -> u / m)", shift, plus)

    def first_shift(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        shift = np.stack(rows["inverse"]) @ np.stack(rows["sums"])
        return pd.DataFrame({by: rows[by], "split": rows["split"], "shift": list(shift)})

    def update(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        between = np.stack(rows["inverse"])
        cells = np.stack(rows["sums"]).reshape(len(rows), len(PRODUCTS), width).transpose(1, 0, 2)
        dq, rr, rq, qq = (part.sum(axis=0) for part in cells[:4])
        r1, q1 = cells[4:]
        now = rr + (r1 * (between @ r1)).sum(axis=0)
        start = now if rows["start"].iloc[0] is None else np.array(rows["start"].iloc[0])
        going = now > tol**2 * start
        lengths = np.where(going, now / np.where(going & (dq > 0), dq, 1.0), 0.0)
        r1 = r1 - lengths * q1
        shift = between @ r1
        left = np.maximum(rr - 2 * lengths * rq + lengths**2 * qq + (r1 * shift).sum(axis=0), 0.0)
        turns = np.where(going, left / np.where(going, now, 1.0), 0.0)
        many = len(rows)
        return pd.DataFrame(
            {
                by: rows[by], "split": rows["split"], "lengths": [lengths] * many, "turns": [turns] * many,
                "shift": list(shift), "start": [start] * many, "open": bool((going & (left > tol**2 * start)).any()),
                "residual": float(np.sqrt((left / np.where(start > 0, start, 1.0)).max())),
                "outside": bool((going & (dq <= 0)).any()),
            }
        )

    diagonal = gram.filter((F.col("split") == F.col("split2")) & (F.col("level") == F.col("level2")))
    diagonal = diagonal.select(*keys, (F.col("n") + alpha).alias("m"))
    sides = rhs.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("r")).join(diagonal, keys)
    sums = F.array(*[F.sum(F.col("r")[i]) for i in range(width)]).alias("sums")
    shifts = sides.groupBy(by, "split").agg(sums).join(coarse, [by, "split"])
    shifts = shifts.groupBy(by).applyInPandas(first_shift, f"{numbers}, shift array<double>")
    state = sides.join(shifts, [by, "split"]).selectExpr(
        *keys, "m", f"array_repeat(0D, {width}) AS x", "r", f"{direction('shift')} AS d"
    )
    state = last = written(state, "cg")
    scalars, done, progress = None, [], _Progress("conjugate gradients", tol)
    array = F.array(*[F.expr(f"sum({text.format(i)})") for text in PRODUCTS for i in range(width)])
    moves = "lengths array<double>, turns array<double>, shift array<double>, start array<double>"
    while True:
        image = product(gram, state, "d", width, [by]).withColumnRenamed("d", "q")
        scaled = f"transform(d, u -> u * {float(alpha)!r}D)"
        step = state.join(image, keys, "left").selectExpr(*keys, "m", "x", "r", "d", f"{zipped('q', scaled, plus)} AS q")
        step = written(step, "cg")
        found = step.groupBy(by, "split").agg(array.alias("sums")).join(coarse, [by, "split"])
        if scalars is None:
            found = found.withColumn("start", F.lit(None).cast("array<double>"))
        else:
            found = found.join(scalars.select(by, "split", "start"), [by, "split"])
        found = found.groupBy(by).applyInPandas(update, f"{numbers}, {moves}, open boolean, residual double, outside boolean")
        found = written(found, "cg-numbers")
        discard(last, *([scalars] if scalars is not None else []))
        last, scalars = step, found
        closed, still, worst, outside = found.agg(
            F.count_if(~F.col("open")), F.count_if("open"), F.max(F.when(F.col("open"), F.col("residual"))), F.max("outside")
        ).first()
        if outside:
            raise NotConverged("conjugate gradients: a right-hand side is outside the range of X'X")
        moved = step.join(found, [by, "split"]).selectExpr(
            *keys, "m", "d", "turns", "shift", "open",
            f"{zipped('x', zipped('d', 'lengths', '(u, f) -> u * f'), plus)} AS x",
            f"{zipped('r', zipped('q', 'lengths', '(u, f) -> u * f'), '(u, v) -> u - v')} AS r",
        )
        if closed or not (done or still):  # without any system there are no rows
            done.append(written(moved.where(~F.col("open")).select(*keys, "x"), "cg-done"))
        if not still:
            break
        state = moved.where("open").selectExpr(
            *keys, "m", "x", "r", f"{zipped(direction('shift'), zipped('d', 'turns', '(u, f) -> u * f'), plus)} AS d"
        )
        progress.note(worst)
    discard(last, scalars, coarse)
    solved = done[0]
    for more in done[1:]:
        solved = solved.unionByName(more)
    return solved.selectExpr(*keys, *[f"x[{i}] AS {c}" for i, c in enumerate(columns)])
