"""Classified batting events: the input of every rate table and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.functions.outcomes import classify, hand_matchup
from splitlab.operators.ranking import all_present, ordinal_in_group, position_marks

SPLITS = (
    "batter", "pitcher", "gamesite", "batterhand", "pitcherhand", "timesthrough", "pitbathand",
)
MODEL_SPLITS = ("batter", "pitcher", "gamesite", "timesthrough", "pitbathand")

#: batters in an order, and the last pass that is told apart
ORDER_LENGTH, LAST_PASS = 9, 2


def check_splits(names) -> tuple[str, ...]:
    names = (names,) if isinstance(names, str) else tuple(names)
    unknown = [name for name in names if name not in SPLITS]
    if unknown or not names:
        raise ValueError(f"unknown split {unknown}; supported: {', '.join(SPLITS)}")
    return names


def times_through(events: DataFrame, order=("event_seq",)) -> DataFrame:
    """Adds ``timesthrough``: 0, 1 or 2 times the pitcher went through the order.

    Only the 10th and 19th event of a (game, pitcher) decide the number, so the
    groups' marks are found first and events are compared with them. No group
    is ever sorted in one task.
    """
    keys = ["gameid", "pitcher"]
    steps = [ORDER_LENGTH * i for i in range(1, LAST_PASS + 1)]
    marks = position_marks(events, keys, order, steps).filter(
        F.col(f"at_{steps[0]}").isNotNull()
    )
    here = F.struct(*order)
    passes = F.lit(0)
    for step in steps:
        passes = passes + F.when(here >= F.col(f"at_{step}"), 1).otherwise(0)
    return (
        events.join(marks, keys, "left")
        .withColumn("timesthrough", F.when(all_present(keys), passes))
        .drop(*[f"at_{step}" for step in steps])
    )


def meeting_number(events: DataFrame, order=("event_seq",)) -> DataFrame:
    """Adds ``meeting``: how often this pitcher met this batter before in the game."""
    return ordinal_in_group(events, ["gameid", "batter", "pitcher"], list(order), "meeting")


def plate_events(
    events: DataFrame, games: DataFrame, order=("event_seq",), vocabulary: str = "coarse"
) -> DataFrame:
    """Batting events with ``gamesite``, ``event``, ``timesthrough``, ``pitbathand``.

    Running counts are taken over all batting events, before any class is
    dropped. What a query does not read is pruned: without ``timesthrough`` its
    marks go away, and so does the join to a ``games`` known to be unique. Hint a
    derived ``games`` with ``broadcast_if_small``; one read from files needs no hint.
    """
    batting = events.filter(F.col("battereventflag") == "T")
    sites = games.select("gameid", "gamesite")
    return (
        times_through(batting, order)
        .join(sites, "gameid", "left")
        .withColumn("event", classify(vocabulary))
        .withColumn("pitbathand", hand_matchup())
    )
