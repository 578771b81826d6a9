"""Inputs of the effect models: design, outcomes, cross products.

The one-hot design is never laid out densely. Linear models need only X'X,
which is a table of co-occurrence counts of levels, and X'y, which follows from
outcome counts per level; both take one scan whatever the number of levels.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlab.functions.metrics import rates
from splitlab.functions.odds import CLAMPS, class_weight, clamp, logit
from splitlab.functions.outcomes import OUTCOMES, not_other
from splitlab.operators.plate import MODEL_SPLITS, check_splits
from splitlab.operators.rates import TOTAL, by_each_split, class_counts, event_freq
from splitlab.session import written

SPACES = ("share", "logit")


def check_space(space: str) -> str:
    if space not in SPACES:
        raise ValueError(f"space must be one of {SPACES}, not {space!r}")
    return space


def event_means(plate: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """One row: each outcome's share among events that have a class, OTHER aside."""
    kept = plate.filter(not_other())
    return kept.agg(
        *[(F.count_if(F.col("event") == e) / F.count("event")).alias(e) for e in outcomes]
    )


def means_struct(means: DataFrame, outcomes=OUTCOMES) -> Column:
    """The one-row means as a scalar subquery, usable in any expression."""
    return means.select(F.struct(*outcomes).alias("m")).scalar()


def _baseline(mean: Column, space: str) -> Column:
    return mean if space == "share" else logit(mean)


def long_design(plate: DataFrame, ids, splits=MODEL_SPLITS) -> DataFrame:
    """The design as a relation (ids, split, level), one row per entry that is 1."""
    cells = plate.select(*ids, *[F.col(s).cast("string").alias(s) for s in check_splits(splits)])
    return cells.unpivot(list(ids), list(splits), "split", "level").dropna(subset=["level"])


def indicators(plate: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """One 0/1 column per outcome, all 0 for an event without a class."""
    return plate.withColumns(
        {e: F.col("event").eqNullSafe(e).cast("double") for e in outcomes}
    )


def residual_outcomes(
    plate: DataFrame, means: DataFrame, space: str = "share", clamp_pair=CLAMPS["narrow"]
) -> DataFrame:
    """Outcome columns less their mean, as shares or as clamped log-odds."""
    check_space(space)
    mean = means_struct(means)
    rows = indicators(plate)
    if space == "logit":
        rows = rows.withColumns({e: logit(clamp(F.col(e), clamp_pair)) for e in OUTCOMES})
    return rows.withColumns({e: F.col(e) - _baseline(mean[e], space) for e in OUTCOMES})


def gram(plate: DataFrame, splits=MODEL_SPLITS, extra=()) -> DataFrame:
    """X'X as (split, level, split2, level2, n), both halves of the symmetric table.

    With ``extra`` keys in front there is one such table for each of their values. One scan: grouping sets over the unordered pairs of splits, counted in each
    task before the shuffle, so that splits of three or four levels do no harm.
    """
    splits, extra = list(check_splits(splits)), list(extra)
    cells = plate.filter(not_other()).select(
        *extra, *[F.col(name).cast("string").alias(name) for name in splits]
    )
    pairs = list(combinations_with_replacement(range(len(splits)), 2))
    bit = [2 ** (len(splits) - 1 - i) for i in range(len(splits))]
    number = {pair: sum(bit) - sum(bit[i] for i in set(pair)) for pair in pairs}

    def side(which: int) -> tuple[Column, Column]:
        place = F.expr(f"map({', '.join(f'{number[p]}L, {p[which]}' for p in pairs)})")[F.col("_set")]
        return F.get(F.array(*map(F.lit, splits)), place), F.get(F.array(*splits), place)

    (split, level), (split2, level2) = side(0), side(1)
    upper = (
        cells.groupingSets([[*extra, *[splits[i] for i in sorted(set(p))]] for p in pairs], *extra, *splits)
        .agg(F.grouping_id(*extra, *splits).alias("_set"), F.count(F.lit(1)).alias("n"))
        .select(
            *extra, split.alias("split"), level.alias("level"),
            split2.alias("split2"), level2.alias("level2"), "n",
        )
        .dropna(subset=["level", "level2"])
    )
    names = ("split", "level", "split2", "level2", "n")
    straight = F.struct(*names)
    mirrored = F.struct(
        *[F.col(b).alias(a) for a, b in zip(names, ("split2", "level2", "split", "level", "n"))]
    )
    both = F.when(F.col("split") == F.col("split2"), F.array(straight)).otherwise(
        F.array(straight, mirrored)
    )
    return upper.select(*extra, F.inline(both))


def level_counts(plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """Event and outcome counts per (split, level), and of all events as ``total``.

    ``n`` counts events with or without a class, ``PA`` those with one.
    """
    sums = [F.count("event").alias("PA"), F.count(F.lit(1)).alias("n"), *class_counts()[1:]]
    return by_each_split(plate.filter(not_other()), splits, sums, with_total=True)


def means_of_counts(counts: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """The one-row mean shares out of ``level_counts``."""
    return counts.filter(F.col("split") == TOTAL).select(
        *[(F.col(e) / F.col("PA")).alias(e) for e in outcomes]
    )


def rates_of_counts(counts: DataFrame) -> DataFrame:
    """Observed rates of all splits stacked, out of ``level_counts``."""
    seen = counts.filter((F.col("split") != TOTAL) & (F.col("PA") > 0))
    return seen.select("split", "level", "PA", *OUTCOMES).withColumns(rates(OUTCOMES))


def xty_of_counts(
    counts: DataFrame, space: str = "share", clamp_pair=CLAMPS["narrow"]
) -> DataFrame:
    """X'y as (split, level, n, one column per outcome) out of ``level_counts``."""
    check_space(space)
    mean = means_struct(means_of_counts(counts))
    n = F.col("n")
    if space == "share":
        sums = {e: F.col(e) - n * mean[e] for e in OUTCOMES}
    else:
        high, low = (logit(F.lit(value)) for value in clamp_pair)
        sums = {e: F.col(e) * high + (n - F.col(e)) * low - n * logit(mean[e]) for e in OUTCOMES}
    levels = counts.filter(F.col("split") != TOTAL)
    return levels.select("split", "level", "n", *[c.alias(e) for e, c in sums.items()])


def xty(
    plate: DataFrame, splits=MODEL_SPLITS, space: str = "share", clamp_pair=CLAMPS["narrow"]
) -> DataFrame:
    """X'y straight from events: their counts are written once and read twice."""
    return xty_of_counts(written(level_counts(plate, splits), "counts"), space, clamp_pair)


def class_weights(plate: DataFrame, kind: str = "odds", made: DataFrame | None = None) -> DataFrame:
    """(event, n, frac, w): weights from frequency, ``odds`` or ``balanced``.

    ``made`` is ``equal_events`` of the same events where the caller has it.
    """
    if made is None:
        freq = event_freq(plate.filter(not_other()))
    else:
        # a handful of rows: one per class
        counts = made.groupBy("event").agg(F.sum("n").alias("n"))
        freq = counts.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy()))
    if kind == "odds":
        weight = class_weight(F.col("frac"))
    elif kind == "balanced":
        # a handful of rows: one per class
        weight = 1 / (F.col("frac") * F.count(F.lit(1)).over(Window.partitionBy()))
    else:
        raise ValueError(f"unknown class weight {kind!r}")
    return freq.withColumn("w", weight)


def equal_events(plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """(splits, event, n): how many events have equal levels and class, OTHER aside.

    Written once, for a multinomial fit and what is read off it.
    """
    events = plate.filter(F.col("event").isNotNull() & not_other())
    levels = [F.col(s).cast("string").alias(s) for s in check_splits(splits)]
    return written(events.groupBy(*levels, "event").agg(F.count(F.lit(1)).alias("n")), "equal-events")


def vector_design(
    plate: DataFrame, splits=MODEL_SPLITS, keep=()
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Sparse one-hot ``features`` and the (split, level) of each position.

    All levels of all splits, no intercept, no level left out; a missing level
    is all zeros. For Spark's own iterative learners.
    """
    splits = check_splits(splits)
    rows = plate.filter(not_other()).select(
        *[F.col(s).cast("string").alias(s) for s in splits], *keep
    )
    numbers, slots = [f"_{s}_number" for s in splits], [f"_{s}_slots" for s in splits]
    # "keep" puts missing levels in one extra slot at the end, which dropLast drops
    indexer = StringIndexer(
        inputCols=list(splits), outputCols=numbers, handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    encoder = OneHotEncoder(inputCols=numbers, outputCols=slots, dropLast=True)
    assembler = VectorAssembler(inputCols=slots, outputCol="features")
    model = Pipeline(stages=[indexer, encoder, assembler]).fit(rows)
    labels = [
        (split, level)
        for split, levels in zip(splits, model.stages[0].labelsArray)
        for level in levels
    ]
    return model.transform(rows).select("features", *keep), labels
