import random

import pytest
from pyspark.sql import functions as F

from splitlab.functions.outcomes import classify, not_other
from splitlab.operators import plate, rates
from splitlab.operators.ranking import ordinal_in_group
from tests.fixtures import games_frame, play, plays_frame

CASES = [
    # code, sh, sf, coarse, fine
    (20, "F", "F", "SNGL", "SNGL"),
    (21, "F", "F", "XBH", "DBL"),
    (22, "F", "F", "XBH", "TRPL"),
    (23, "F", "F", "HR", "HR"),
    (14, "F", "F", "BB", "UBB"),
    (15, "F", "F", "OTHER", "IBB"),
    (16, "F", "F", "BB", "HBP"),
    (17, "F", "F", "OTHER", "OTHER"),
    (18, "F", "F", "OTHER", "OTHER"),
    (2, "F", "F", "BIPOUT", "BIPOUT"),
    (19, "F", "F", "BIPOUT", "BIPOUT"),
    (3, "F", "F", "K", "K"),
    (2, "T", "F", "OTHER", "SH"),
    (2, "F", "T", "BIPOUT", "SF"),
    (2, "T", "T", "BIPOUT", "SF"),
    (0, "F", "F", "UNKNOWN", "UNKNOWN"),
    (1, "F", "F", "NOBAT", "NOBAT"),
    (24, "F", "F", "NOBAT", "NOBAT"),
    (99, "F", "F", None, None),
]


@pytest.mark.parametrize("vocabulary,place", [("coarse", 3), ("fine", 4)])
def test_classes(spark, vocabulary, place):
    rows = [play(i, c[0], sh=c[1], sf=c[2]) for i, c in enumerate(CASES)]
    made = plays_frame(spark, rows).withColumn("event", classify(vocabulary)).orderBy("event_seq")
    assert [r.event for r in made.collect()] == [c[place] for c in CASES]


def test_unknown_vocabulary_and_split():
    with pytest.raises(ValueError):
        classify("medium")
    with pytest.raises(ValueError):
        plate.check_splits("weather")


def test_plate_events(spark):
    rows = [
        play(1, bhand=None),
        play(2, 4, flag="F"),
        play(3, game="G9"),
        play(4, 15),
        play(5, 99),
    ]
    made = plate.plate_events(plays_frame(spark, rows), games_frame(spark))
    found = {r.event_seq: r for r in made.collect()}
    assert sorted(found) == [1, 3, 4, 5]
    assert found[1].pitbathand is None and found[3].pitbathand == "LR"
    assert found[3].gamesite is None and found[1].gamesite == "S1"
    kept = made.filter(not_other())
    assert sorted(r.event_seq for r in kept.collect()) == [1, 3, 5]


def test_times_through(spark):
    rows, seq = [], 0
    for i in range(30):
        seq += 1
        rows.append(play(seq, 15 if i % 4 == 0 else 20, batter=f"b{i % 9}"))
        if i == 8:
            seq += 1
            rows.append(play(seq, 4, flag="F"))
    first = [r[2] for r in rows if r[8] == "T"]
    rows += [play(seq + 1 + i, pitcher="p2") for i in range(10)]
    rows += [play(seq + 50, pitcher=None)]
    random.Random(1).shuffle(rows)
    made = plate.plate_events(plays_frame(spark, rows), games_frame(spark))
    found = {r.event_seq: r.timesthrough for r in made.collect()}
    assert [found[s] for s in first] == [0] * 9 + [1] * 9 + [2] * 12
    assert [found[seq + 1 + i] for i in range(10)] == [0] * 9 + [1]
    assert found[seq + 50] is None


def test_times_through_against_row_numbers(spark):
    rng = random.Random(3)
    # one pitcher holds a third of all events
    rows = [
        play(i, 20, pitcher="p0" if rng.random() < 0.33 else f"p{rng.randrange(40)}",
             game=f"G{rng.randrange(2)}")
        for i in rng.sample(range(10**6), 3000)
    ]
    made = plate.times_through(plays_frame(spark, rows))
    seen, expected = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        key = (r[1], r[5])
        expected[r[2]] = min(seen.get(key, 0) // 9, 2)
        seen[key] = seen.get(key, 0) + 1
    assert {r.event_seq: r.timesthrough for r in made.collect()} == expected


@pytest.mark.parametrize("chunks", [2, 30, 400])
def test_ordinal_against_brute_force(spark, chunks):
    rng = random.Random(chunks)
    rows = [
        ("a" if rng.random() < 0.4 else rng.choice("bcd"), rng.choice(["x", "y", None]), s)
        for s in rng.sample(range(10**5), 2000)
    ]
    df = spark.createDataFrame(rows, "k string, j string, s bigint")
    made = ordinal_in_group(df, ["k", "j"], ["s"], "nth", chunks)
    seen, expected = {}, {}
    for k, j, s in sorted(rows, key=lambda r: r[2]):
        expected[s] = None if j is None else seen.get((k, j), 0)
        seen[(k, j)] = seen.get((k, j), 0) + 1
    assert {r.s: r.nth for r in made.collect()} == expected
    assert made.columns == ["k", "j", "s", "nth"]


def test_ordinal_of_nothing(spark):
    df = spark.createDataFrame([], "k string, s bigint")
    assert ordinal_in_group(df, ["k"], ["s"], "nth").count() == 0


def test_meeting_number(spark):
    rows = [play(s, batter=b) for s, b in [(5, "x"), (1, "x"), (3, "y"), (9, "x")]]
    made = plate.meeting_number(plays_frame(spark, rows))
    assert {r.event_seq: r.meeting for r in made.collect()} == {1: 0, 5: 1, 9: 2, 3: 0}
    counts = rates.matchup_counts(plays_frame(spark, rows))
    assert {r.batter: r.n for r in counts.collect()} == {"x": 3, "y": 1}


def test_filter_of_class_stays_above_the_count(spark):
    """Dropping OTHER must not change who is counted in the running number."""
    rows = [play(i, 15 if i < 9 else 20) for i in range(12)]
    made = plate.plate_events(plays_frame(spark, rows), games_frame(spark)).filter(not_other())
    assert {r.timesthrough for r in made.select("timesthrough", "event").collect()} == {1}
    assert made.filter(F.col("timesthrough") == 1).count() == 3
