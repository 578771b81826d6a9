"""Leaderboards: totals, thresholds, names, top and bottom lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.functions import metrics
from splitlab.operators.lookups import attach

LEADER_SUMS = ("G", "PA", "RBI", "wRC", "wRAA", "BsR", "Bat", "Off", "Def", "WAR")


def named(rates: DataFrame, people: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Adds ``Name`` by player ID; ``how='inner'`` keeps only known players."""
    return attach(rates, people.select("ID", "Name"), key, "ID", how)


def placed(rates: DataFrame, parks: DataFrame) -> DataFrame:
    """Adds the park's ``NAME`` to site rows."""
    return attach(rates, parks.select("PARKID", "NAME"), "gamesite", "PARKID")


def top(df: DataFrame, by: str, k: int, ties=()) -> DataFrame:
    """The k largest, NULLs last; ``ties`` columns make equal values reproducible."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(k)


def bottom(df: DataFrame, by: str, k: int, ties=()) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last(), *ties).limit(k)


def ordered(df: DataFrame, by: str, descending: bool = False, ties=()) -> DataFrame:
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(key, *ties)


def leaderboard(
    lines: DataFrame,
    first: int,
    last: int,
    by_season: bool = True,
    minpa: int = 0,
    teams=None,
    sums=LEADER_SUMS,
) -> DataFrame:
    """Stat lines of a season range, per (player, season) or per player.

    ``minpa`` is the qualifier on the summed PA, ``teams`` an optional filter.
    """
    chosen = lines.filter(F.col("Season").between(first, last))
    if teams is not None:
        chosen = chosen.filter(F.col("Team").isin(*teams))
    keys = ["Name", "Season"] if by_season else ["Name"]
    present = [name for name in sums if name in lines.columns]
    totals = chosen.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in present])
    return totals.filter(F.col("PA") >= minpa)


def dh_value(board: DataFrame, positive_only: bool = False) -> DataFrame:
    """What a fielder's runs lose against batting as a designated hitter."""
    valued = board.withColumns(metrics.dh_metrics())
    return valued.filter(F.col("DefImp") > 0) if positive_only else valued


def overrated(board: DataFrame) -> DataFrame:
    return board.withColumns(metrics.overrated_metrics())


def pa_check(board: DataFrame) -> DataFrame:
    """PA next to the PA rebuilt from its parts."""
    return board.withColumn("xPA", metrics.expected_pa())
