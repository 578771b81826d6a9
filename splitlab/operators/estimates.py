"""From effects back to probabilities, and estimates next to observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.functions import metrics
from splitlab.functions.odds import inverse_logit, logit, normalised, odds, row_total
from splitlab.functions.outcomes import OUTCOMES
from splitlab.operators.design import check_space, means_struct
from splitlab.operators.lookups import broadcast_if_small
from splitlab.operators.plate import MODEL_SPLITS
from splitlab.operators.rates import long_rates
from splitlab.session import written

KEYS = ["split", "level"]


def to_probabilities(
    effects: DataFrame, means: DataFrame, space: str = "share", outcomes=OUTCOMES
) -> DataFrame:
    """Effects on top of the mean shares: added, or on the log-odds scale."""
    check_space(space)
    mean = means_struct(means, outcomes)
    if space == "share":
        made = {e: F.col(e) + mean[e] for e in outcomes}
    else:
        made = {e: inverse_logit(F.col(e) + logit(mean[e])) for e in outcomes}
    return effects.withColumns(made)


def to_odds(effects: DataFrame, means: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """Effects as odds: exp(b) times the odds of the mean."""
    mean = means_struct(means, outcomes)
    return effects.withColumns({e: F.exp(F.col(e)) * odds(mean[e]) for e in outcomes})


def intercept_odds(intercepts: DataFrame) -> DataFrame:
    """(event, b, odds, sigmoid): each class score through its own inverse logit, which is no share."""
    return intercepts.withColumns({"odds": F.exp("b"), "sigmoid": inverse_logit(F.col("b"))})


def mean_ratio(intercepts: DataFrame, freq: DataFrame) -> DataFrame:
    """Inverse logits of the scores next to observed shares: (event, sigmoid, frac, ratio)."""
    return (
        intercept_odds(intercepts)
        .join(freq.select("event", "frac"), "event")
        .select("event", "sigmoid", "frac", F.try_divide("sigmoid", "frac").alias("ratio"))
    )


def with_total(estimates: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    return estimates.withColumn("SUM", row_total(outcomes))


def normalise(estimates: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """Outcomes scaled to sum to one; a SUM column takes no part."""
    return estimates.withColumns(normalised(outcomes))


def star_rates(
    plate: DataFrame, level_rates: DataFrame, splits=MODEL_SPLITS, columns=OUTCOMES
) -> DataFrame:
    """Each event with the rates of its level in every split: ``<split>_<column>``.

    One lookup per split, each broadcast only if it measures small; events are
    not shuffled for the small ones.
    """
    level_rates = written(level_rates.select(*KEYS, *columns), "levels")
    joined = plate
    for split in splits:
        lookup = level_rates.filter(F.col("split") == split).select(
            F.col("level").alias("_level"), *[F.col(c).alias(f"{split}_{c}") for c in columns]
        )
        key = F.col(split).cast("string") == F.col("_level")
        joined = joined.join(broadcast_if_small(lookup), key, "left").drop("_level")
    return joined


def fitted(plate: DataFrame, effects: DataFrame, splits=MODEL_SPLITS, outcomes=OUTCOMES):
    """X b per event: the sum of its levels' effects, in one column per outcome."""
    star = star_rates(plate, effects, splits, outcomes)
    sums = {}
    for outcome in outcomes:
        parts = [F.coalesce(F.col(f"{s}_{outcome}"), F.lit(0.0)) for s in splits]
        sums[outcome] = sum(parts[1:], parts[0])
    return star.select(*plate.columns, *[c.alias(e) for e, c in sums.items()])


def mean_over_events(counts: DataFrame, estimates: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """Mean estimate over the events of each split, from counts per level."""
    return (
        counts.select(*KEYS, "PA")
        .join(estimates.select(*KEYS, *outcomes), KEYS)
        .groupBy("split")
        .agg(*[(F.sum(F.col(e) * F.col("PA")) / F.sum("PA")).alias(e) for e in outcomes])
    )


def observed_and_estimated(
    observed: DataFrame, estimated: DataFrame, outcomes=OUTCOMES
) -> DataFrame:
    """Side by side by level, columns ``<outcome>_obs`` and ``<outcome>_est``."""
    left = observed.select(*KEYS, "PA", *[F.col(e).alias(f"{e}_obs") for e in outcomes])
    right = estimated.select(*KEYS, *[F.col(e).alias(f"{e}_est") for e in outcomes])
    return left.join(right, KEYS)


def long_comparison(observed: DataFrame, estimated: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """The same in long form: (split, level, event, obs, est, PA)."""
    left = long_rates(observed, KEYS, (*outcomes, "PA")).withColumnRenamed("value", "obs")
    right = long_rates(estimated, KEYS, outcomes).withColumnRenamed("value", "est")
    weights = observed.select(*KEYS, "PA")
    return left.join(right, [*KEYS, "event"]).join(weights, KEYS)


def estimated_board(
    estimates: DataFrame, observed: DataFrame, constants: DataFrame, season: int, split: str
) -> DataFrame:
    """Estimates of one split with PA and one season's weighted metrics."""
    of_split = estimates.filter(F.col("split") == split).select(
        F.col("level").alias(split), *OUTCOMES
    )
    weights = observed.filter(F.col("split") == split).select(F.col("level").alias(split), "PA")
    one_season = constants.filter(F.col("Season") == season)
    weight = one_season.select(F.struct(*metrics.SEASON_WEIGHTS).alias("w")).scalar()
    return (
        of_split.join(weights, split, "left")
        .withColumns({name: weight[name] for name in metrics.SEASON_WEIGHTS})
        .withColumns(metrics.weighted_metrics())
        .drop(*metrics.SEASON_WEIGHTS)
    )
