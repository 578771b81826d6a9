"""Outcome counts and rates per split level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlab.functions import metrics
from splitlab.functions.outcomes import FINE_OUTCOMES, OUTCOMES, not_other
from splitlab.operators.plate import MODEL_SPLITS, check_splits

LONG_SPLIT = ["split", "level"]


def class_counts(outcomes=OUTCOMES) -> list[Column]:
    """PA over all classes present, and one conditional count per outcome."""
    return [
        F.count(F.lit(1)).alias("PA"),
        *[F.count_if(F.col("event") == name).alias(name) for name in outcomes],
    ]


def outcome_counts(plate: DataFrame, keys, outcomes=OUTCOMES) -> DataFrame:
    """Count pivot. Rows without a class or a key take no part, also not in PA."""
    keys = list(keys)
    return plate.dropna(subset=[*keys, "event"]).groupBy(*keys).agg(*class_counts(outcomes))


def with_metrics(rates: DataFrame, constants: DataFrame) -> DataFrame:
    """Season-weighted metrics; seasons without weights get NULL for WOBA, FIP."""
    weights = constants.select(F.col("Season").alias("season"), *metrics.SEASON_WEIGHTS)
    return (
        rates.join(weights, "season", "left")
        .withColumns(metrics.weighted_metrics())
        .drop(*metrics.SEASON_WEIGHTS)
    )


def rate_table(
    plate: DataFrame, split: str | Sequence[str], constants: DataFrame, minpa: int = 0
) -> DataFrame:
    """Rates and season-weighted metrics by (season, split level), OTHER dropped.

    ``split`` may also be a list of splits, grouped together.
    """
    keys = ["season", *check_splits(split)]
    counts = outcome_counts(plate.filter(not_other()), keys).filter(F.col("PA") >= minpa)
    return with_metrics(counts.withColumns(metrics.rates(OUTCOMES)), constants)


def fixed_rate_table(plate: DataFrame, split: str | Sequence[str], minpa: int = 0) -> DataFrame:
    """Rates with OTHER kept as a class and metrics with fixed weights."""
    keys = ["season", *check_splits(split)]
    outcomes = (*OUTCOMES, "OTHER")
    counts = outcome_counts(plate, keys, outcomes).filter(F.col("PA") >= minpa)
    return counts.withColumns(metrics.rates(outcomes)).withColumns(metrics.fixed_metrics())


def fine_counts(plate: DataFrame, key: str = "batter", minpa: int = 0) -> DataFrame:
    """Counts of the fine classes with AB, from plate events in that vocabulary."""
    keys = ["season", *check_splits(key)]
    counts = outcome_counts(plate, keys, FINE_OUTCOMES).filter(F.col("PA") >= minpa)
    return counts.withColumn("AB", metrics.at_bats())


def fine_table(plate: DataFrame, key: str = "batter", minpa: int = 0) -> DataFrame:
    return fine_counts(plate, key, minpa).withColumns(metrics.fine_metrics())


def fine_percentages(plate: DataFrame, key: str = "batter", minpa: int = 0) -> DataFrame:
    shares = metrics.fine_percentages()
    counts = fine_counts(plate, key, minpa)
    return counts.select("season", key, *[c.alias(name) for name, c in shares.items()])


TOTAL = "total"


def by_each_split(
    plate: DataFrame, splits, aggregates, extra=(), with_total: bool = False
) -> DataFrame:
    """One aggregate per (extra keys, split, level) for several splits in one scan.

    Grouping sets instead of a pass per split; a level that is missing takes no
    part in its split. ``with_total`` adds the rows of all events as one more
    split, ``total``.
    """
    splits, extra = list(check_splits(splits)), list(extra)
    cells = plate.withColumns({name: F.col(name).cast("string") for name in splits})
    groups = [[*extra, name] for name in splits] + ([[*extra]] if with_total else [])
    grouped = cells.groupingSets(groups, *extra, *splits).agg(
        F.grouping_id(*extra, *splits).alias("_set"), *aggregates
    )
    top = 2 ** len(splits) - 1
    sets = {name: top - 2 ** (len(splits) - 1 - i) for i, name in enumerate(splits)}
    split, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, number in sets.items():
        split = F.when(F.col("_set") == number, name).otherwise(split)
        level = F.when(F.col("_set") == number, F.col(name)).otherwise(level)
    if with_total:
        split = F.when(F.col("_set") == top, TOTAL).otherwise(split)
        level = F.when(F.col("_set") == top, TOTAL).otherwise(level)
    return (
        grouped.withColumn("split", split)
        .withColumn("level", level)
        .drop("_set", *splits)
        .filter(F.col("level").isNotNull())
    )


def split_counts(plate: DataFrame, splits=MODEL_SPLITS, outcomes=OUTCOMES, extra=()) -> DataFrame:
    """Counts of all splits stacked: extra keys, split, level, PA, outcomes."""
    kept = plate.filter(not_other() & F.col("event").isNotNull())
    counts = by_each_split(kept, splits, class_counts(outcomes), extra)
    return counts.select(*extra, *LONG_SPLIT, "PA", *outcomes)


def split_rates(plate: DataFrame, splits=MODEL_SPLITS, extra=()) -> DataFrame:
    """Observed rates of all splits stacked: the table models are compared with."""
    return split_counts(plate, splits, extra=extra).withColumns(metrics.rates(OUTCOMES))


def long_rates(rates: DataFrame, ids=("split", "level"), values=(*OUTCOMES, "PA")) -> DataFrame:
    """Wide to long, PA as one more variable."""
    wide = rates.select(*ids, *[F.col(name).cast("double").alias(name) for name in values])
    return wide.unpivot(list(ids), list(values), "event", "value")


def wide_rates(long: DataFrame, ids=("split", "level"), values=(*OUTCOMES, "PA")) -> DataFrame:
    """Long to wide with named columns; an absent pair stays NULL."""
    return long.groupBy(*ids).pivot("event", list(values)).agg(F.first("value"))


def complete_grid(long: DataFrame, value: str, outcomes=OUTCOMES) -> DataFrame:
    """(split, level, event, value) with a row for every level and outcome, absent ones 0."""
    cells = [F.coalesce(F.max(F.when(F.col("event") == e, F.col(value))), F.lit(0.0)).alias(e) for e in outcomes]
    wide = long.groupBy(*LONG_SPLIT).agg(*cells)
    return wide.unpivot(list(LONG_SPLIT), list(outcomes), "event", value)


def event_freq(plate: DataFrame, keys=()) -> DataFrame:
    """Share of each class among events with a class, overall or per key."""
    keys = list(keys)
    counts = (
        plate.dropna(subset=[*keys, "event"])
        .groupBy(*keys, "event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # at most one row per class in each window
    return counts.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def event_freq_of_all(plate: DataFrame, keys=()) -> DataFrame:
    """As ``event_freq`` but events without a class count in the total."""
    keys = list(keys)
    counts = plate.groupBy(*keys, "event").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("frac", share).dropna(subset=[*keys, "event"])


def season_freq(plate: DataFrame) -> DataFrame:
    """One row per season: class shares side by side with the fixed-weight metrics."""
    outcomes = (*OUTCOMES, "OTHER")
    counts = outcome_counts(plate, ["season"], outcomes).withColumns(metrics.rates(outcomes))
    made = metrics.fixed_metrics()
    return counts.withColumns({k: made[k] for k in ("AVG", "OBP", "WOBA")}).drop("PA")


def metric_by_season(table: DataFrame, column: str, metric: str, levels) -> DataFrame:
    """Line series: one row per season, one column per level of ``column``."""
    return table.groupBy("season").pivot(column, list(levels)).agg(F.first(metric))


def matchup_counts(plate: DataFrame, keys=("gameid", "batter", "pitcher")) -> DataFrame:
    """Events of each combination; one with a missing key is none."""
    return plate.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def present_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"))
