"""Odds, log-odds and their inverses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an observed 1 and an observed 0 count as before the log-odds.
CLAMPS = {
    "wide": (0.999, 0.0002),
    "middle": (0.9999, 0.00002),
    "narrow": (0.99999, 0.000002),
}


def odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def logit(p: Column) -> Column:
    return F.log(odds(p))


def inverse_logit(b: Column) -> Column:
    return 1 / (1 + F.exp(-b))


def clamp(indicator: Column, clamp_pair: tuple[float, float]) -> Column:
    high, low = clamp_pair
    return F.when(indicator == 1, F.lit(high)).when(indicator == 0, F.lit(low)).otherwise(indicator)


def class_weight(p: Column) -> Column:
    return F.sqrt(odds(p))


def row_total(names) -> Column:
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return total


def normalised(names) -> dict[str, Column]:
    """Each column over the sum of all, so that a row sums to one."""
    total = row_total(names)
    return {name: F.try_divide(F.col(name), total) for name in names}
