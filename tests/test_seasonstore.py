"""The season store: what changed is written, and readers see whole generations only."""

import os

import pytest

from splitlab.sources import ingest, seasonstore


def line(game, i):
    return f'"{game}",1,0,0,"b{i}","R","p1","L","S7/G,{i}",20,"T","T",1,"F","F",0\n'


def put(folder, name, rows, start=0):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line(name[:7], i) for i in range(start, start + rows)))


@pytest.fixture
def place(spark, tmp_path):
    put(tmp_path / "in", "2013AAA.EVA.csv", 3)
    put(tmp_path / "in", "2013BBB.EVN.csv", 2)
    put(tmp_path / "in", "2014AAA.EVA.csv", 4)
    store = str(tmp_path / "store")
    assert seasonstore.refresh(spark, str(tmp_path / "in"), store) == [2013, 2014]
    return tmp_path / "in", store


def counts(spark, store, **options):
    table = seasonstore.read_store(spark, store, **options)
    return {r.season: r["count"] for r in table.groupBy("season").count().collect()}


def tree(store):
    return sorted(os.path.join(d, f) for d, _, files in os.walk(store) for f in files)


def test_first_run_holds_all_rows_as_the_scan_gives_them(spark, place):
    folder, store = place
    assert counts(spark, store) == {2013: 5, 2014: 4}
    table = seasonstore.read_store(spark, store)
    scan = ingest.scan_plays(spark, str(folder))
    assert set(table.columns) == set(scan.columns)
    same = [c for c in scan.columns if c != "event_seq"]
    assert sorted(map(str, table.select(same).collect())) == sorted(map(str, scan.select(same).collect()))


def test_rerun_writes_nothing(spark, place):
    folder, store = place
    before = tree(store)
    assert seasonstore.refresh(spark, str(folder), store) == []
    os.utime(folder / "2014AAA.EVA.csv", (1, 1))  # another time, the same bytes
    assert seasonstore.refresh(spark, str(folder), store) == []
    assert seasonstore.refresh(spark, str(folder), store, verify=True) == []
    assert tree(store) == before


def test_only_changed_seasons_are_written(spark, place):
    folder, store = place
    put(folder, "2014AAA.EVA.csv", 4, start=1)  # as many rows, other bytes
    put(folder, "2015AAA.EVA.csv", 1)
    assert seasonstore.refresh(spark, str(folder), store) == [2014, 2015]
    assert counts(spark, store) == {2013: 5, 2014: 4, 2015: 1}
    written = {n for n in os.listdir(f"{store}/seasons/generation=2") if n.startswith("season=")}
    assert written == {"season=2014", "season=2015"}
    batters = {r.batter for r in seasonstore.read_store(spark, store, 2014, 2014).collect()}
    assert batters == {"b1", "b2", "b3", "b4"}
    held = {(r.season, r.generation) for r in seasonstore.manifest(spark, store).collect()}
    assert held == {(2013, 1), (2014, 2), (2015, 2)}


def test_same_length_and_time_is_seen_by_verify_only(spark, place):
    folder, store = place
    file = folder / "2014AAA.EVA.csv"
    was = file.stat()
    file.write_text(file.read_text().replace('"b1"', '"b9"'))
    os.utime(file, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert seasonstore.refresh(spark, str(folder), store) == []
    assert seasonstore.refresh(spark, str(folder), store, verify=True) == [2014]


def test_a_file_that_goes_changes_its_season_and_a_season_without_files_stays(spark, place):
    folder, store = place
    os.remove(folder / "2013BBB.EVN.csv")
    os.remove(folder / "2014AAA.EVA.csv")
    assert seasonstore.refresh(spark, str(folder), store) == [2013]
    assert counts(spark, store) == {2013: 3, 2014: 4}
    assert seasonstore.refresh(spark, str(folder), store) == []


@pytest.mark.parametrize("when", ["rows", "manifest"])
def test_a_failed_run_leaves_the_old_seasons(spark, place, monkeypatch, when):
    folder, store = place
    put(folder, "2014AAA.EVA.csv", 9)

    def broken(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(seasonstore, "_publish", broken)
        scan = broken if when == "rows" else ingest.scan_plays
        with pytest.raises(RuntimeError):
            seasonstore.refresh(spark, str(folder), store, scan=scan)
    assert counts(spark, store) == {2013: 5, 2014: 4}
    assert seasonstore.refresh(spark, str(folder), store) == [2014]
    assert counts(spark, store) == {2013: 5, 2014: 9}
    assert counts(spark, store, generation=1) == {2013: 5, 2014: 4}


def test_a_manifest_without_its_mark_does_not_count(spark, place):
    folder, store = place
    put(folder, "2014AAA.EVA.csv", 9)
    seasonstore.refresh(spark, str(folder), store)
    os.remove(f"{store}/manifests/2/_SUCCESS")
    assert seasonstore.generations(spark, store) == [1]
    assert counts(spark, store) == {2013: 5, 2014: 4}
    assert seasonstore.refresh(spark, str(folder), store) == [2014]  # as generation 3
    assert seasonstore.generations(spark, store) == [1, 3]


def test_range_reads_its_folders_only(spark, place):
    _, store = place
    files = seasonstore.read_store(spark, store, first=2014).inputFiles()
    assert files and all("season=2014" in f for f in files)
    with pytest.raises(ValueError):
        seasonstore.read_store(spark, store, first=2020)
    with pytest.raises(ValueError):
        seasonstore.read_store(spark, store + "x")


def test_prune_keeps_what_is_needed(spark, place):
    folder, store = place
    for n in (5, 6, 7):
        put(folder, "2014AAA.EVA.csv", n)
        seasonstore.refresh(spark, str(folder), store)
    assert seasonstore.prune(spark, store, keep=2) == [1, 2]
    assert counts(spark, store) == {2013: 5, 2014: 7}
    assert counts(spark, store, generation=3) == {2013: 5, 2014: 6}
    assert not os.path.exists(f"{store}/seasons/generation=1/season=2014")
    assert not os.path.exists(f"{store}/seasons/generation=2")


def test_names_have_to_tell_season_and_file(spark, place):
    folder, store = place
    put(folder / "more", "2013AAA.EVA.csv", 1)
    with pytest.raises(ValueError, match="two files"):
        seasonstore.refresh(spark, str(folder), store)
    os.rename(folder / "more" / "2013AAA.EVA.csv", folder / "more" / "AAA.EVA.csv")
    with pytest.raises(ValueError, match="no season"):
        seasonstore.refresh(spark, str(folder), store)
