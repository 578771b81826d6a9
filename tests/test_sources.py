import pytest

from splitlab.functions.coerce import coerce_cells, coerce_columns, numeric_text_columns
from splitlab.operators.plate import plate_events
from splitlab.sources import html_tables, ingest, readers

CONSTANTS = """﻿"Season","wOBA","wOBAScale","wBB","wHBP","w1B","w2B","w3B","wHR","runSB","runCS","R/PA","R/W","cFIP"
"2013",".301","1.201",".601",".701",".801","1.101","1.401","1.701",".250","-.450",".101","8.001","2.501"
"2012",".302","1.202",".602",".702",".802","1.102","1.402","1.702",".250","-.460",".102","8.002","2.502"
"""
PARKS = """PARKID,NAME,AKA,CITY,STATE,START,END,LEAGUE,NOTES
AAA01,First Park,,Town,NY,01/02/1901,03/04/1905,NL,"one:1/2/01;3/4,5/6/1902"
AAA02,"Second, Park",Old; Older,Town,CA,05/06/1955,,AL,""
AAA03,Third Park,,Town,NE,07/08/2001,07/08/2001,"ZZ9"
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_constants(spark, tmp_path):
    table = readers.read_season_constants(spark, put(tmp_path / "c.csv", CONSTANTS))
    rows = {r.Season: r for r in table.collect()}
    assert rows[2013].wBB == 0.601 and rows[2013].runCS == -0.45
    assert rows[2012]["R/PA"] == 0.102 and rows[2012].cFIP == 2.502


def test_parks(spark, tmp_path):
    table = readers.read_parks(spark, put(tmp_path / "p.csv", PARKS))
    rows = {r.PARKID: r for r in table.collect()}
    assert rows["AAA01"].NOTES == "one:1/2/01;3/4,5/6/1902"
    assert rows["AAA02"].NAME == "Second, Park" and rows["AAA02"].END is None
    assert rows["AAA03"].LEAGUE == "ZZ9" and rows["AAA03"].NOTES is None


def test_people(spark, tmp_path):
    path = put(tmp_path / "i.csv", "Last,First,ID,Debut\nRuth,Babe,r1,1914,\nCher,,c1,1965,\n")
    rows = {r.ID: r.Name for r in readers.read_people(spark, path).collect()}
    assert rows == {"r1": "Babe Ruth", "c1": None}


def test_games_and_plays(spark, tmp_path):
    games = put(
        tmp_path / "g.csv",
        "gameid,date,hometeam,awayteam,gamesite\nAAA201304010,130401,AAA,BBB,AAA01\n",
    )
    head = "gameid,inning,battingteam,outs,batter,batterhand,pitcher,pitcherhand,eventtext,eventtype,battereventflag,abflag,hitvalue,shflag,sfflag,outsonplay\n"
    plays = put(tmp_path / "e.csv", head + "AAA201304010,1,0,0,b1,R,p1,L,S7/G,20,T,T,1,F,F,0\n")
    game = readers.read_games(spark, games).first()
    play = readers.read_plays(spark, plays).first()
    assert game.gamesite == "AAA01" and game.date == "130401"
    assert play.eventtype == 20 and play.shflag == "F" and play.outsonplay == 0


def play_line(game, i):
    return f'"{game}",1,0,0,"b{i}","R","p1","L","S7/G,{i}",20,"T","T",1,"F","F",0\n'


def test_ingest_keeps_file_order(spark, tmp_path):
    """Files cut into many blocks still give numbers in line order."""
    for name, n in (("2013AAA.EVA.csv", 900), ("2013BBB.EVN.csv", 37), ("2014AAA.EVA.csv", 5)):
        put(tmp_path / "in" / name, "".join(play_line(name[:7], i) for i in range(n)))
    put(tmp_path / "in" / "2013AAA.ROS.csv", "not,a,play\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = ingest.scan_plays(spark, str(tmp_path / "in"))
        assert scan.rdd.getNumPartitions() > 5
        out = str(tmp_path / "out")
        ingest.write_seasons(scan, out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    table = readers.read_seasons(spark, out, 2013, 2013)
    rows = table.select("source_file", "event_seq", "batter", "eventtext", "eventtype").collect()
    assert len(rows) == 937
    for name, n in (("2013AAA.EVA.csv", 900), ("2013BBB.EVN.csv", 37)):
        found = sorted((r.event_seq, r.batter) for r in rows if r.source_file == name)
        assert len({seq for seq, _ in found}) == n
        assert [b for _, b in found] == [f"b{i}" for i in range(n)]
    assert {r.eventtype for r in rows} == {20}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_ingest_replaces_only_its_season(spark, tmp_path):
    out = str(tmp_path / "out")
    for name in ("2013AAA.EVA.csv", "2014AAA.EVA.csv"):
        put(tmp_path / "a" / name, play_line("g", 1) * 3)
    ingest.write_seasons(ingest.scan_plays(spark, str(tmp_path / "a")), out)
    put(tmp_path / "b" / "2014AAA.EVA.csv", play_line("g", 2))
    ingest.write_seasons(ingest.scan_plays(spark, str(tmp_path / "b")), out)
    counts = {r.season: r["count"] for r in readers.read_seasons(spark, out).groupBy("season").count().collect()}
    assert counts == {2013: 3, 2014: 1}


def test_ingest_picks_positions(spark, tmp_path):
    line = ",".join(str(i) for i in range(41)) + "\n"
    put(tmp_path / "2013AAA.EVA.csv", line)
    row = ingest.scan_plays(spark, str(tmp_path), ingest.PLAY_FIELDS).first()
    assert (row.gameid, row.inning, row.batter, row.pitcher, row.eventtext) == ("0", 2, "10", "14", "29")
    assert (row.eventtype, row.outsonplay, row.season) == (34, 40, 2013)
    game = ingest.scan_games(spark, str(tmp_path), ingest.GAME_FIELDS).first()
    assert (game.gameid, game.date, game.hometeam, game.awayteam, game.gamesite) == ("0", "1", "8", "7", "9")


def test_from_files_to_plate_events(spark, tmp_path):
    put(tmp_path / "in" / "2013AAA.EVA.csv", "".join(play_line("g1", i) for i in range(12)))
    ingest.write_seasons(ingest.scan_plays(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    games = spark.createDataFrame([("g1", "S1")], "gameid string, gamesite string")
    made = plate_events(readers.read_seasons(spark, str(tmp_path / "out")), games)
    found = {r.batter: r.timesthrough for r in made.collect()}
    assert found == {f"b{i}": int(i >= 9) for i in range(12)}


def test_pitches_between(spark):
    rows = [(1, "2019-02-01", "single"), (2, "2019-04-23", "walk"), (3, "2019-03-01", None), (4, "2019-04-24", "walk")]
    df = spark.createDataFrame(rows, "index bigint, d string, events string").selectExpr(
        "index", "CAST(d AS DATE) AS game_date", "1 AS batter", "2 AS pitcher", "events",
        "'R' AS stand", "'L' AS p_throws", "'H' AS home_team", "'A' AS away_team",
    )
    found = readers.pitches_between(df, "2019-02-01", "2019-04-23")
    assert sorted(r["index"] for r in found.collect()) == [1, 2]


PAGE = """<html><table><tbody><tr><td>menu</td></tr></tbody></table>
<table class="x" id="board"><thead><tr><td>pages: <a>1</a></td></tr>
<tr><th>#</th><th><a>Name</a></th><th>wRC+</th></tr><tr><td>filler</td></tr></thead>
<tbody></tbody><tbody><tr><td>1</td><td><a href="x">A &amp; B</a></td><td>120</td></tr>
<tr><td>2<td>Short</tr></tbody></table><table id="other"><tr><td>no</td></tr></table></html>"""


def test_html_table(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, "u", "<p>nothing</p>"), (3, "u", None), (4, "u", "")],
        "page_id bigint, url string, html string",
    )
    cells = html_tables.table_cells(pages, "board").cache()
    body = html_tables.leaderboard_cells(cells)
    rows = html_tables.table_rows(body, ["#", "Name", "wRC+"]).orderBy("row_no").collect()
    assert [(r["#"], r.Name, r["wRC+"]) for r in rows] == [("1", "A & B", "120"), ("2", "Short", None)]
    promoted = html_tables.promote_header(cells)
    assert sorted(map(tuple, promoted.collect())) == sorted(map(tuple, body.collect()))
    small = html_tables.table_cells(pages, "board", rows_per_batch=1)
    assert sorted(map(str, small.collect())) == sorted(map(str, cells.collect()))


def test_nested_table_text_belongs_to_its_cell(spark):
    html = '<table id="t"><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>'
    found = html_tables._read_page(html, "t")
    assert {(row, col, cell) for _, row, col, _, cell, _ in found} == {(1, 1, "ab"), (2, 1, "b"), (1, 2, "c")}


def test_coercion(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "x", "R", None), ("3", "--", "4", "S", None)],
        "a string, b string, `wRC+` string, name string, empty string",
    )
    assert numeric_text_columns(df) == ["a", "empty"]
    kinds = dict(coerce_columns(df).dtypes)
    assert kinds["a"] == "double" and kinds["b"] == "string" and kinds["wRC+"] == "string"
    made = coerce_cells(df, ["a", "b", "wRC+"]).orderBy("a").collect()
    assert [(r.a, r.b, r["wRC+"]) for r in made] == [(1.0, 2.5, None), (3.0, None, 4.0)]
    assert coerce_columns(df.select("name")).dtypes == [("name", "string")]


def test_work_dir_needs_a_setting_off_local(spark):
    from splitlab import session

    class Remote:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://elsewhere"

    with pytest.raises(ValueError):
        session.work_dir(Remote)
    assert session.size_in_bytes("10485760b") == session.size_in_bytes("10MB") == 10 * 2**20
    assert session.size_in_bytes("-1") == -1
