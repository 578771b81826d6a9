"""Small hand-made plays."""

from __future__ import annotations

import random

PLAY_DDL = (
    "season int, gameid string, event_seq bigint, batter string, batterhand string, "
    "pitcher string, pitcherhand string, eventtype int, battereventflag string, "
    "shflag string, sfflag string"
)


def play(seq, code=20, batter="b1", pitcher="p1", game="G1", flag="T", sh="F", sf="F",
         bhand="R", phand="L", season=2013):
    return (season, game, seq, batter, bhand, pitcher, phand, code, flag, sh, sf)


def plays_frame(spark, rows):
    return spark.createDataFrame(rows, PLAY_DDL)


def games_frame(spark, rows=(("G1", "S1"),)):
    return spark.createDataFrame(list(rows), "gameid string, gamesite string")


def plate_rows(n=400, seed=5, levels=(6, 4)):
    """Classified events over two splits, for the models."""
    rng = random.Random(seed)
    names = ["SNGL", "XBH", "HR", "BB", "K", "BIPOUT"]
    rows = []
    for i in range(n):
        batter, pitcher = rng.randrange(levels[0]), rng.randrange(levels[1])
        weights = [3 + batter, 2, 1 + pitcher, 3, 4 + (batter * pitcher) % 3, 6]
        rows.append((i, f"b{batter}", f"p{pitcher}", rng.choices(names, weights)[0]))
    return rows


def plate_frame(spark, rows):
    return spark.createDataFrame(rows, "event_seq bigint, batter string, pitcher string, event string")
