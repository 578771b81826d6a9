import pytest

from splitlab.functions.outcomes import OUTCOMES
from splitlab.operators import plate, rates, spread
from tests.fixtures import games_frame, play, plays_frame

WEIGHTS = "Season int, wBB double, wHBP double, w1B double, w2B double, w3B double, wHR double, cFIP double"


@pytest.fixture(scope="module")
def constants(spark):
    return spark.createDataFrame([(2013, 0.6, 0.7, 0.8, 1.1, 1.4, 1.7, 2.5)], WEIGHTS)


@pytest.fixture(scope="module")
def events(spark):
    rows = [play(i, code) for i, code in enumerate([20, 20, 21, 23, 14, 3, 3, 2, 0, 15, 99])]
    rows += [play(100, 20, batter="b2"), play(101, 20, batter="b2", season=2014, game="G2")]
    rows += [play(102, 3, batter=None)]
    return plate.plate_events(plays_frame(spark, rows), games_frame(spark))


def one(df, **where):
    found = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(found) == 1
    return found[0]


def test_weighted_table(events, constants):
    row = one(rates.rate_table(events, "batter", constants), batter="b1", season=2013)
    # UNKNOWN counts in PA; OTHER and the code without a class do not
    assert row.PA == 9
    assert (row.SNGL, row.XBH, row.HR, row.BB, row.K, row.BIPOUT) == pytest.approx(
        [2 / 9, 1 / 9, 1 / 9, 1 / 9, 2 / 9, 1 / 9]
    )
    assert row.AVG == pytest.approx((4 / 9) / (8 / 9))
    assert row.OBP == pytest.approx(5 / 9)
    assert row.WOBA == pytest.approx(
        (2 * 0.8 + 0.9 * 1.1 + 0.1 * 1.4 + 1.7 + 0.9 * 0.6 + 0.1 * 0.7) / 9
    )
    assert row.FIP == pytest.approx((13 + 3 - 4) / 3 * 3 + 2.5)


def test_season_without_weights(events, constants):
    row = one(rates.rate_table(events, "batter", constants), season=2014)
    assert row.WOBA is None and row.FIP is None and row.AVG == 1.0


def test_zero_divisor_gives_null(events, constants):
    row = one(rates.rate_table(events, "batter", constants), batter="b2", season=2013)
    assert row.FIP is None and row.SNGL == 1.0


def test_minpa_and_missing_level(events, constants):
    table = rates.rate_table(events, "batter", constants, minpa=2)
    assert {(r.season, r.batter) for r in table.collect()} == {(2013, "b1")}


def test_fixed_table_keeps_other(events):
    row = one(rates.fixed_rate_table(events, "batter"), batter="b1")
    assert row.PA == 10 and row.OTHER == pytest.approx(0.1)
    assert row.AVG == pytest.approx(4 / 7)
    assert row.OBP == pytest.approx(5 / 8)
    assert row.WOBA == pytest.approx((2 * 0.89 + 1.31 + 2.10 + 0.70) / 10 / 0.9)
    assert row.FIP == pytest.approx((13 + 3 - 4) / 3 * 3 + 3.05)


def test_fine_table(spark):
    codes = [20, 21, 22, 23, 14, 15, 16, 3, 2]
    rows = [play(i, c) for i, c in enumerate(codes)]
    rows += [play(20, 2, sh="T"), play(21, 2, sf="T")]
    events = plate.plate_events(plays_frame(spark, rows), games_frame(spark), vocabulary="fine")
    row = one(rates.fine_table(events))
    assert (row.PA, row.AB) == (11, 6)
    assert row.BA == pytest.approx(4 / 6)
    assert row.OBP == pytest.approx(7 / 10)
    assert row.WOBA == pytest.approx((0.69 + 0.72 + 0.89 + 1.27 + 1.62 + 2.10) / 9)
    shares = one(rates.fine_percentages(events))
    assert shares.BB == pytest.approx(2 / 11) and shares.BIPOUT == pytest.approx(2 / 11)


def test_frequencies(events):
    dropped = {r.event: r.frac for r in rates.event_freq(events).collect()}
    counted = {r.event: r.frac for r in rates.event_freq_of_all(events).collect()}
    assert sum(dropped.values()) == pytest.approx(1)
    assert dropped["K"] == pytest.approx(3 / 13) and counted["K"] == pytest.approx(3 / 14)
    present = events.filter("event IS NOT NULL")
    same = {r.event: r.frac for r in rates.event_freq_of_all(present).collect()}
    assert same == pytest.approx(dropped)


def test_all_splits_in_one_pass_equals_one_by_one(events):
    stacked = {(r.split, r.level): r.PA for r in rates.split_rates(events, plate.SPLITS).collect()}
    single = {}
    for split in plate.SPLITS:
        kept = events.filter("event IS NULL OR event <> 'OTHER'")
        for r in rates.outcome_counts(kept, [split]).collect():
            single[(split, str(r[split]))] = r.PA
    assert stacked == single


def test_long_and_wide_again(events):
    table = rates.split_rates(events)
    again = rates.wide_rates(rates.long_rates(table)).collect()
    wide = {(r.split, r.level): r for r in table.collect()}
    assert len(again) == len(wide)
    for r in again:
        assert [r[e] for e in OUTCOMES] == pytest.approx([wide[r.split, r.level][e] for e in OUTCOMES])


def test_spread_skips_pairs_never_seen(events):
    found = {(r.split, r.event): r.var for r in spread.rate_spread(events).collect()}
    # only one batter ever had a HR, so there is no variance to speak of
    assert found["batter", "HR"] is None
    assert found["batter", "SNGL"] == pytest.approx((1 - 2 / 9) ** 2 / 2)


def test_weighted_means_agree_over_splits(spark):
    rows = [play(i, [20, 21, 23, 14, 3, 2][i % 6], batter=f"b{i % 5}", pitcher=f"p{i % 7}") for i in range(60)]
    events = plate.plate_events(plays_frame(spark, rows), games_frame(spark))
    means = spread.weighted_means(rates.split_rates(events)).collect()
    assert len(means) == 5
    for r in means:
        assert [r[e] for e in OUTCOMES] == pytest.approx([1 / 6] * 6)


def test_series_by_season(events, constants):
    table = rates.rate_table(events, "timesthrough", constants)
    series = rates.metric_by_season(table, "timesthrough", "AVG", [0, 1, 2])
    assert series.columns == ["season", "0", "1", "2"]
    assert {r.season for r in series.collect()} == {2013, 2014}
