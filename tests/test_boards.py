import numpy as np
import pytest

from splitlab.operators import bins, boards
from splitlab.operators.lookups import broadcast_if_small, measured_bytes

LINE = "Name string, Season int, Team string, G bigint, PA bigint, RBI double, wRC double, wRAA double, BsR double, Bat double, Off double, Def double, WAR double"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("A", 2000, "X", 162, 600, 100.0, 90.0, 10.0, 1.0, 9.0, 10.0, -30.0, 3.0),
        ("A", 2001, "X", 81, 300, 40.0, 50.0, 5.0, 0.0, 4.0, 4.0, -10.0, 1.0),
        ("B", 2000, "Y", 81, 300, 40.0, 50.0, 5.0, 0.0, 4.0, 4.0, -10.0, 1.0),
        ("C", 1990, "Y", 100, 400, 40.0, 50.0, 5.0, 0.0, 4.0, 4.0, 20.0, 1.0),
    ]
    return spark.createDataFrame(rows, LINE)


def test_dh_value(lines):
    made = boards.dh_value(boards.leaderboard(lines, 2000, 2001))
    found = {(r.Name, r.Season): (r.DefDH, r.DefImp, r.DefImp162) for r in made.collect()}
    assert found["A", 2000] == pytest.approx((-17.5, 12.5, 12.5))
    assert found["B", 2000] == pytest.approx((-8.75, 1.25, 2.5))
    assert ("C", 1990) not in found


def test_career_and_qualifier(lines):
    made = boards.leaderboard(lines, 1980, 2010, by_season=False, minpa=500)
    assert [(r.Name, r.PA, r.Def) for r in made.collect()] == [("A", 900, -40.0)]
    assert boards.leaderboard(lines, 1980, 2010, teams=["Y"]).count() == 2
    positive = boards.dh_value(boards.leaderboard(lines, 1980, 2010), positive_only=True)
    assert {r.Name for r in positive.collect()} == {"A", "B"}


def test_top_and_bottom_with_ties(lines):
    made = boards.overrated(boards.leaderboard(lines, 1980, 2010))
    worst = boards.bottom(made, "Bat_RBI", 3, ["Name", "Season"]).collect()
    assert [(r.Name, r.Season, r.Bat_RBI) for r in worst] == [
        ("A", 2000, -91.0), ("A", 2001, -36.0), ("B", 2000, -36.0),
    ]
    best = boards.top(made, "wRC_RBI", 2, ["Name", "Season"]).collect()
    assert [(r.Name, r.wRC_RBI) for r in best] == [("A", 10.0), ("B", 10.0)]
    assert worst[0].Off_RBI == -90.0 and worst[0].wRAA_RBI == -90.0
    ordered = boards.ordered(lines, "G", descending=True).collect()
    assert ordered[0].G == 162


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(None,), (2.0,), (1.0,)], "v double")
    assert [r.v for r in boards.top(df, "v", 3).collect()] == [2.0, 1.0, None]
    assert [r.v for r in boards.bottom(df, "v", 3).collect()] == [1.0, 2.0, None]


def test_pa_check(spark):
    names = ["1B", "2B", "3B", "HR", "BB", "IBB", "SO", "HBP", "SF", "SH"]
    ddl = ", ".join(f"`{n}` int" for n in ["PA", *names])
    df = spark.createDataFrame([(70, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], ddl)
    assert boards.pa_check(df).first().xPA == 55


def test_names(spark):
    rates = spark.createDataFrame([("p1", 1), ("p2", 2)], "pitcher string, PA int")
    people = spark.createDataFrame([("p1", "One"), ("p1", "Uno")], "ID string, Name string")
    left = boards.named(rates, people, "pitcher")
    assert sorted((r.pitcher, r.Name or "") for r in left.collect()) == [("p1", "One"), ("p1", "Uno"), ("p2", "")]
    assert boards.named(rates, people, "pitcher", how="inner").count() == 2


def test_broadcast_is_checked(spark):
    df = spark.createDataFrame([("x" * 100,)] * 50, "s string")
    assert measured_bytes(df) == 50 * 108
    hint = "ResolvedHint (strategy=broadcast)"

    def hinted(frame):
        return hint in frame._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_if_small(df))
    assert not hinted(broadcast_if_small(df, 5000))
    assert not hinted(broadcast_if_small(df, -1))


def test_histogram_like_numpy(spark):
    rng = np.random.default_rng(2)
    values, weights = rng.random(200), rng.integers(1, 50, 200)
    rows = [("s", "HR", float(v), int(w)) for v, w in zip(values, weights)]
    rows += [("t", "HR", 0.25, 7)]
    df = spark.createDataFrame(rows, "split string, event string, value double, PA bigint")
    for weight in (None, "PA"):
        made = bins.histogram(df, 10, weight).orderBy("split", "bin").collect()
        counts, edges = np.histogram(values, 10, weights=None if weight is None else weights)
        assert [r.amount for r in made[:10]] == pytest.approx(list(counts))
        assert [r.lo for r in made[:10]] == pytest.approx(list(edges[:-1]))
        assert [r.hi for r in made[:10]] == pytest.approx(list(edges[1:]))
        flat = np.histogram([0.25], 10, weights=[1 if weight is None else 7])[0]
        assert [r.amount for r in made[10:]] == list(flat)


def test_bins_and_density(spark):
    rng = np.random.default_rng(4)
    x, y, w = rng.random(60), rng.random(60), rng.integers(1, 9, 60)
    rows = [("s", float(a), float(b), int(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame(rows, "split string, x double, y double, PA bigint")
    made = np.zeros((5, 5))
    for r in bins.bins2d(df, "x", "y", 5).collect():
        made[r.x_bin, r.y_bin] = r.n
    assert np.array_equal(made, np.histogram2d(x, y, 5)[0])
    h = 0.1
    for r in bins.kde2d(df, "x", "y", "PA", h, 4).collect():
        kernel = np.exp(-((x - r.x) ** 2 + (y - r.y) ** 2) / (2 * h * h)) / (2 * np.pi * h * h)
        assert r.density == pytest.approx((w * kernel).sum() / w.sum())


def test_binned_density_within_its_error(spark):
    """Clusters far apart, one point alone, a range of no width: off by less than the stated error."""
    rng = np.random.default_rng(8)
    rows = [("a", float(c + rng.normal(0, 0.02)), float(rng.random()), int(w)) for c in (0, 3) for w in rng.integers(1, 9, 40)]
    rows += [("b", 0.3, 0.7, 5), ("c", 0.5, 0.1, 1), ("c", 0.5, 0.4, 2)]
    odd = [("a", None, 0.5, 3), ("a", 0.5, None, 3), ("d", 0.0, 0.0, 0), ("d", 1.0, 1.0, 0)]
    schema = "split string, x double, y double, PA bigint"
    df = spark.createDataFrame(rows + odd, schema)
    plain = {(r.split, r.x_no, r.y_no): r for r in bins.kde2d(spark.createDataFrame(rows, schema), "x", "y", "PA", 0.1, 5).collect()}
    for fineness in (2, 16):
        made = {(r.split, r.x_no, r.y_no): r for r in bins.binned_density(df, "x", "y", "PA", 0.1, 5, fineness).collect()}
        assert len(made) == 4 * 25
        assert all(r.density is None for k, r in made.items() if k[0] == "d")
        allowed, worst = bins.density_error(0.1, fineness), 0.0
        for key, r in plain.items():
            assert (made[key].x, made[key].y) == pytest.approx((r.x, r.y))
            worst = max(worst, abs(made[key].density - r.density))
        assert worst <= allowed + 1e-12
    assert not bins.binned_density(df.limit(0), "x", "y", "PA", 0.1).collect()


def test_binned_density_keeps_the_mass(spark):
    rows = [("s", i / 97, (i * 7 % 97) / 97, 1) for i in range(98)]
    df = spark.createDataFrame(rows, "split string, x double, y double, PA bigint")
    dealt = bins.binned_density(df, "x", "y", "PA", 0.05, 50)
    total = sum(r.density for r in dealt.collect()) / 49 / 49
    assert 0.7 < total < 1.05  # mass beyond the range is not on the grid
