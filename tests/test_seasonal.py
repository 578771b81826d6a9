"""Models of many seasons at once, against NumPy for each season."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlab.functions.outcomes import OUTCOMES
from splitlab.operators import bins, design, regress, seasonal
from tests.fixtures import plate_frame, plate_rows

SPLITS = ["batter", "pitcher"]
ROWS = plate_rows()


@pytest.fixture(scope="module")
def events(spark):
    # seasons of different sizes, and events without one
    place = F.col("event_seq") % 7
    season = F.when(place < 4, 1990).when(place < 6, 1991).when(F.col("event_seq") % 14 == 6, 1992)
    return plate_frame(spark, ROWS).withColumn("season", season.cast("int")).cache()


def of_season(events, season):
    rows = events.filter(F.col("season") == season).select("batter", "pitcher", "event").collect()
    labels = sorted({("batter", r.batter) for r in rows}) + sorted({("pitcher", r.pitcher) for r in rows})
    at = {label: i for i, label in enumerate(labels)}
    x, y = np.zeros((len(rows), len(labels))), np.zeros((len(rows), len(OUTCOMES)))
    for i, r in enumerate(rows):
        x[i, at["batter", r.batter]] = x[i, at["pitcher", r.pitcher]] = 1
        y[i, OUTCOMES.index(r.event)] = 1
    return labels, x, y - y.mean(axis=0)


def test_every_season_equals_numpy(events):
    found = {}
    for r in seasonal.ridge_by_season(events, 2.0, SPLITS).collect():
        found.setdefault(r.season, {})[r.split, r.level] = [r[e] for e in OUTCOMES]
    assert sorted(found) == [1990, 1991, 1992]
    for season, effects in found.items():
        labels, x, y = of_season(events, season)
        assert sorted(effects) == sorted(labels)
        want = np.linalg.solve(x.T @ x + 2.0 * np.eye(len(labels)), x.T @ y)
        assert np.array([effects[label] for label in labels]) == pytest.approx(want, abs=1e-7)


def test_one_season_equals_the_pooled_solver(events):
    one = events.filter(F.col("season") == 1991)
    pooled = {(r.split, r.level): [r[e] for e in OUTCOMES] for r in regress.ridge(one, 5.0, SPLITS, "logit").collect()}
    by_season = seasonal.ridge_by_season(events, 5.0, SPLITS, "logit").filter(F.col("season") == 1991).collect()
    assert {(r.split, r.level) for r in by_season} == set(pooled)
    for r in by_season:
        assert [r[e] for e in OUTCOMES] == pytest.approx(pooled[r.split, r.level], abs=1e-6)


def test_closed_form_and_counts(events):
    counts = seasonal.season_counts(events, SPLITS)
    want = {}
    for season in (1990, 1991, 1992):
        own = design.level_counts(events.filter(F.col("season") == season), SPLITS)
        for r in regress.shrunken_means(own, 10.0).collect():
            want[season, r.split, r.level] = [r[e] for e in OUTCOMES]
    found = {(r.season, r.split, r.level): [r[e] for e in OUTCOMES] for r in seasonal.shrunken_by_season(counts, 10.0).collect()}
    assert set(found) == set(want)
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_board_uses_each_seasons_weights(spark, events):
    counts = seasonal.season_counts(events, SPLITS).cache()
    made = seasonal.probabilities_by_season(seasonal.shrunken_by_season(counts, 10.0), counts)
    names = ("Season", "wBB", "wHBP", "w1B", "w2B", "w3B", "wHR", "cFIP")
    constants = spark.createDataFrame([(1990, *[1.0] * 7), (1991, *[2.0] * 7)], "Season int, " + ", ".join(f"{n} double" for n in names[1:]))
    board = seasonal.season_board(made, counts, constants, "batter")
    for r in board.collect():
        total = r.SNGL + r.XBH + r.HR + r.BB
        want = {1990: total, 1991: 2 * total}.get(r.season)
        assert r.WOBA == (pytest.approx(want) if want is not None else None)
    top = seasonal.top_of_season(board, "WOBA", 2, ["batter"]).collect()
    assert sorted((r.season, r.place) for r in top) == [(s, p) for s in (1990, 1991, 1992) for p in (1, 2)]


def test_no_events(events):
    none = events.filter("false")
    assert seasonal.shrunken_by_season(seasonal.season_counts(none, SPLITS), 1.0).count() == 0
    assert seasonal.ridge_by_season(none, 1.0, SPLITS).count() == 0


def test_hexagons_take_the_nearest_centre(spark):
    rng = np.random.default_rng(3)
    rows = [("s", float(x), float(y)) for x, y in zip(rng.uniform(-2, 5, 400), rng.gamma(2, 1, 400), strict=True)]
    rows += [("t", 1.0, 1.0), ("t", 1.0, 1.0), ("s", None, 2.0)]
    found = bins.hexbins(spark.createDataFrame(rows, "split string, x double, y double"), "x", "y", 8).collect()
    x, y = (np.array([r[i] for r in rows[:400]]) for i in (1, 2))
    wide, high = np.ptp(x) / 8, np.ptp(y) / 4
    centres = [
        (lattice, i, j, x.min() + wide * (i + lattice / 2), y.min() + high * (j + lattice / 2))
        for lattice in (0, 1) for i in range(10) for j in range(6)
    ]
    place = np.array([c[3:] for c in centres])
    away = ((x[:, None] - place[:, 0]) / wide) ** 2 + 3 * ((y[:, None] - place[:, 1]) / high) ** 2
    nearest = np.bincount(away.argmin(axis=1), minlength=len(centres))
    want = {centres[k][:3]: (pytest.approx(centres[k][3:]), n) for k, n in enumerate(nearest.tolist()) if n}
    got = {(r.lattice, r.x_no, r.y_no): ((r.x, r.y), r.n) for r in found if r.split == "s"}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == want[k][0] for k in want)
    assert [r.n for r in found if r.split == "t"] == [2]
