"""Effect of each split level on each outcome: (split, level, one column per outcome)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.functions.odds import CLAMPS
from splitlab.functions.outcomes import OUTCOMES
from splitlab.operators import blocks, design, softmax
from splitlab.operators.estimates import fitted
from splitlab.operators.plate import MODEL_SPLITS
from splitlab.operators.rates import TOTAL, by_each_split
from splitlab.operators.solvers import (
    KEYS, NotConverged, active_set_lasso, column_product, conjugate_gradient, least_norm, prepared, released, scaled,
)
from splitlab.session import discard, written


MOST_ITERATIONS = 1000
#: Coefficients (levels times classes) up to which the multinomial learner holds them in the driver.
DRIVER_COEFFICIENTS = 1 << 15


class System(NamedTuple):
    """Normal equations of a linear model: X'X, laid out for products, X'y and the counts behind them."""

    left: DataFrame
    rhs: DataFrame
    counts: DataFrame


def system(
    plate: DataFrame, splits=MODEL_SPLITS, space="share", clamp_pair=CLAMPS["narrow"], tau: dict[str, float] | None = None
) -> System:
    """Both sides of the normal equations, for a fit and the check of it.

    The columns that they read of the events are written once; what follows works on tables of levels.
    """
    events = written(plate.select(*splits, "event"), "events")
    counts = written(design.level_counts(events, splits), "counts")
    rhs = design.xty_of_counts(counts, space, clamp_pair)
    left = design.gram(events, splits)
    if tau:
        left, rhs = scaled(left, rhs, OUTCOMES, tau)
    left = prepared(left)
    discard(events)
    return System(left, rhs, counts)


def ridge(
    plate: DataFrame, alpha: float, splits=MODEL_SPLITS, space="share", clamp_pair=CLAMPS["narrow"],
    made: System | None = None,
) -> DataFrame:
    """Ridge without intercept: minimises |y - Xb|^2 + alpha |b|^2.

    ``made``, here and below, is the ``system`` of the same arguments where the caller has it.
    """
    left, rhs, _ = made or system(plate, splits, space, clamp_pair)
    effects = written(conjugate_gradient(left, rhs, OUTCOMES, alpha), "effects")
    if not made:
        released(left)
    return effects


def min_norm(
    plate: DataFrame,
    splits=MODEL_SPLITS,
    space="share",
    clamp_pair=CLAMPS["narrow"],
    tau: dict[str, float] | None = None,
    made: System | None = None,
) -> DataFrame:
    """Least squares of least norm; ``tau`` multiplies a split's design columns.

    Effects stay on the multiplied columns.
    """
    left, rhs, _ = made or system(plate, splits, space, clamp_pair, tau)
    effects = written(least_norm(left, rhs, OUTCOMES)[0], "effects")
    if not made:
        released(left)
    return effects


def shrunken_means(counts: DataFrame, alpha: float, space="share") -> DataFrame:
    """Ridge for each split on its own, in closed form from ``design.level_counts``."""
    sums = design.xty_of_counts(counts, space)
    return sums.select(*KEYS, *[(F.col(e) / (F.col("n") + alpha)).alias(e) for e in OUTCOMES])


def normal_gap(
    plate: DataFrame,
    effects: DataFrame,
    splits=MODEL_SPLITS,
    space="share",
    clamp_pair=CLAMPS["narrow"],
    tau: dict[str, float] | None = None,
    made: System | None = None,
) -> DataFrame:
    """X'(y - Xb) per level and outcome, with the effect and the level's count."""
    left, rhs, _ = made or system(plate, splits, space, clamp_pair, tau)
    image = column_product(left, effects, OUTCOMES).select(
        *KEYS, *[F.col(e).alias(f"fit_{e}") for e in OUTCOMES]
    )
    named = effects.select(*KEYS, *[F.col(e).alias(f"b_{e}") for e in OUTCOMES])
    gap = (
        rhs.join(image, KEYS)
        .join(named, KEYS)
        .select(
            *KEYS, "n", *[(F.col(e) - F.col(f"fit_{e}")).alias(e) for e in OUTCOMES],
            *[f"b_{e}" for e in OUTCOMES],
        )
    )
    gap = written(gap, "gap")
    if not made:
        released(left)
    return gap


def _effect_table(spark, labels, columns: dict) -> DataFrame:
    rows = [
        (*label, *[float(values[i]) for values in columns.values()])
        for i, label in enumerate(labels)
    ]
    kinds = ", ".join(f"{name} double" for name in columns)
    return spark.createDataFrame(rows, f"split string, level string, {kinds}")


def least_squares(
    plate: DataFrame, splits=MODEL_SPLITS, space="logit", clamp_pair=CLAMPS["narrow"],
    made: System | None = None,
) -> DataFrame:
    """Plain least squares; on this singular design only fitted values are unique."""
    left, rhs, _ = made or system(plate, splits, space, clamp_pair)
    effects = written(conjugate_gradient(left, rhs, OUTCOMES), "effects")
    if not made:
        released(left)
    return effects


def lasso(
    plate: DataFrame, alpha: float, splits=MODEL_SPLITS, space="logit", clamp_pair=CLAMPS["narrow"],
    made: System | None = None,
) -> DataFrame:
    """Lasso without intercept: minimises |y - Xb|^2 / 2N + alpha |b|_1."""
    left, rhs, counts = made or system(plate, splits, space, clamp_pair)
    total = counts.filter(F.col("split") == TOTAL).first()["n"]
    found = active_set_lasso(left, rhs, OUTCOMES, alpha * total)
    effects = written(found, "effects")
    if not made:
        released(left)
    return effects


def in_blocks(events: DataFrame, splits=MODEL_SPLITS) -> blocks.Packed | None:
    """``design.equal_events`` laid out for ``blocks.fit``; None for a model that is not fitted by it."""
    return blocks.packed(events, splits, DRIVER_COEFFICIENTS) if len(splits) > 2 else None


def multinomial(
    plate: DataFrame, splits=MODEL_SPLITS, weights: DataFrame | None = None, c: float = 1.0,
    made: DataFrame | None = None, packed: blocks.Packed | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Multinomial logistic with intercept and a squared penalty of 1 / (2 c).

    ``weights`` is (event, w), such as ``class_weights``. Returns the effects
    (split, level, one column per class) and the intercepts (event, b). Events with
    equal levels and class are one row that weighs as many; ``NotConverged`` is
    raised if the learner stops at its bound of iterations. Spark's learner sends all
    coefficients through the driver in every iteration; beyond ``DRIVER_COEFFICIENTS`` models
    of one or two splits are fitted by ``softmax.fit``, which sends inner products only, and
    those of more splits, all but one of few levels, by ``blocks.fit``.
    ``made``, here and below, is ``design.equal_events`` of the same arguments where the caller has it,
    and ``packed`` is ``in_blocks`` of that.
    """
    spark = plate.sparkSession
    events = made or design.equal_events(plate, splits)
    held = packed or in_blocks(events, splits)
    if held:
        found = blocks.fit(held, weights, c, tol=1e-7)
        if not packed:
            discard(held.rows)
        return found
    if len(splits) <= 2:
        levels = by_each_split(events, splits, [F.count(F.lit(1)).alias("rows")]).count()
        if levels * events.select("event").distinct().count() > DRIVER_COEFFICIENTS:
            return softmax.fit(events, splits, weights, c, tol=1e-7)
    rows, labels = design.vector_design(events, splits, ["event", "n"])
    classes = StringIndexer(inputCol="event", outputCol="label", stringOrderType="alphabetAsc")
    indexed = classes.fit(rows)
    rows = indexed.transform(rows)
    if weights is None:
        rows = rows.withColumn("w", F.col("n").cast("double"))
    else:
        # one row per outcome class
        rows = rows.join(F.broadcast(weights.select("event", "w")), "event")
        rows = rows.withColumn("w", F.col("w") * F.col("n"))
    rows = written(rows.select("features", "label", "w"), "design")
    learner = LogisticRegression(
        family="multinomial", weightCol="w", standardization=False, fitIntercept=True,
        elasticNetParam=0.0, regParam=1.0 / (c * rows.agg(F.sum("w")).first()[0]),
        tol=1e-9, maxIter=MOST_ITERATIONS,
    )
    model = learner.fit(rows)
    if model.summary.totalIterations >= MOST_ITERATIONS:
        raise NotConverged(f"multinomial: {MOST_ITERATIONS} iterations")
    names = list(indexed.labels)
    matrix = model.coefficientMatrix.toArray()
    effects = _effect_table(spark, labels, dict(zip(names, matrix)))
    intercepts = [(e, float(b)) for e, b in zip(names, model.interceptVector.toArray())]
    return effects, spark.createDataFrame(intercepts, "event string, b double")


def _softmax(events, effects, intercepts, splits, classes) -> DataFrame:
    """The fitted share of each class at each event."""
    # one row per outcome class
    base = intercepts.agg(
        F.map_from_entries(F.collect_list(F.struct("event", "b"))).alias("m")
    ).scalar()
    scores = fitted(events, effects, splits, classes)
    scores = scores.withColumns({c: F.exp(F.col(c) + base[c]) for c in classes})
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return scores.withColumns({c: F.col(c) / total for c in classes})


def fitted_shares(
    plate: DataFrame, effects: DataFrame, intercepts: DataFrame, splits=MODEL_SPLITS,
    made: DataFrame | None = None,
) -> DataFrame:
    """(event, share): mean fitted share of each class over the events.

    With a free intercept it equals the observed share at the optimum of an unweighted fit.
    """
    classes = [name for name in effects.columns if name not in KEYS]
    shares = _softmax(made or design.equal_events(plate, splits), effects, intercepts, splits, classes)
    means = shares.agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in classes])
    return means.unpivot([], classes, "event", "share")


def _residuals(events, effects, intercepts, splits, weights, classes) -> DataFrame:
    """(split, level, n, classes): weighted observed less fitted class totals of a level."""
    if weights is None:
        events = events.withColumn("w", F.col("n").cast("double"))
    else:
        # one row per outcome class
        events = events.join(F.broadcast(weights.select("event", "w")), "event")
        events = events.withColumn("w", F.col("w") * F.col("n"))
    scores = _softmax(events, effects, intercepts, splits, classes)
    scores = scores.withColumns(
        {c: F.col("w") * ((F.col("event") == c).cast("double") - F.col(c)) for c in classes}
    )
    sums = [F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in classes]]
    return by_each_split(scores, splits, sums)


def multinomial_gap(
    plate: DataFrame,
    effects: DataFrame,
    intercepts: DataFrame,
    splits=MODEL_SPLITS,
    weights: DataFrame | None = None,
    made: DataFrame | None = None, packed: blocks.Packed | None = None,
) -> DataFrame:
    """Gradient of the multinomial fit per level and class; zero at the optimum.

    Weighted observed less fitted class totals of a level, less its effect.
    """
    classes = [name for name in effects.columns if name not in KEYS]
    if packed:
        gaps = blocks.residuals(packed, effects, intercepts, weights)
    else:
        gaps = _residuals(made or design.equal_events(plate, splits), effects, intercepts, splits, weights, classes)
    named = effects.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in classes])
    return gaps.join(named, KEYS).select(
        *KEYS, "n", *[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in classes]
    )
