"""How far the levels of a split lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlab.functions.outcomes import OUTCOMES, not_other
from splitlab.operators.plate import MODEL_SPLITS
from splitlab.operators.rates import by_each_split, long_rates


def level_freq(plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """Share of each class within each level; pairs never seen have no row."""
    kept = plate.filter(not_other() & F.col("event").isNotNull())
    counts = by_each_split(kept, splits, [F.count(F.lit(1)).alias("n")], extra=["event"])
    level = Window.partitionBy("split", "level")
    return counts.select("split", "level", "event", (F.col("n") / F.sum("n").over(level)).alias("frac"))


def rate_spread(plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """Sample variance and deviation of level shares, per split and class."""
    return (
        level_freq(plate, splits)
        .groupBy("split", "event")
        .agg(F.var_samp("frac").alias("var"), F.stddev_samp("frac").alias("std"))
    )


def estimate_spread(estimates: DataFrame, columns=OUTCOMES) -> DataFrame:
    """Unweighted mean, deviation and variance of estimates by split and column."""
    long = long_rates(estimates, ("split", "level"), columns)
    return long.groupBy("split", "event").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("var"),
    )


def weighted_means(rates: DataFrame, columns=OUTCOMES) -> DataFrame:
    """PA-weighted mean of each outcome column by split."""
    return rates.groupBy("split").agg(
        *[(F.sum(F.col(c) * F.col("PA")) / F.sum("PA")).alias(c) for c in columns]
    )


def shrinkage(estimates: DataFrame, plate: DataFrame, splits=MODEL_SPLITS) -> DataFrame:
    """Variance of estimates over that of observed shares, averaged over outcomes."""
    estimated = estimate_spread(estimates).select("split", "event", F.col("var").alias("var_est"))
    observed = rate_spread(plate, splits).select("split", "event", F.col("var").alias("var_obs"))
    return (
        estimated.join(observed, ["split", "event"])
        .groupBy("split")
        .agg(F.avg(F.try_divide("var_est", "var_obs")).alias("ratio"))
    )
