"""The same results in plain SQL, for a second engine over the same tables."""

from __future__ import annotations

from splitlab.plans.testbed import CONSTANT_COLUMNS, CONSTANTS

SIX = ("SNGL", "XBH", "HR", "BB", "K", "BIPOUT")
FINE = ("SNGL", "DBL", "TRPL", "HR", "UBB", "IBB", "HBP", "K", "SF", "SH", "BIPOUT", "OTHER")
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MODEL_SPLITS = ("batter", "pitcher", "gamesite", "timesthrough", "pitbathand")

CONSTS = "consts({}) AS (VALUES {})".format(
    ", ".join(CONSTANT_COLUMNS),
    ", ".join("(" + ", ".join(f"CAST({v} AS {'INT' if i == 0 else 'DOUBLE'})" for i, v in enumerate(row)) + ")" for row in CONSTANTS),
)

GAMES = """games AS (
  SELECT DISTINCT 'G' || CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS VARCHAR) AS gameid,
    'S' || CAST((year(l_shipdate) * 4 + quarter(l_shipdate)) % 12 AS VARCHAR) AS gamesite
  FROM lineitem WHERE year(l_shipdate) * 10 + quarter(l_shipdate) <> 19972)"""

PLAYS = """plays AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season,
    'G' || CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS VARCHAR) AS gameid,
    p_brand AS batter, CAST(l_suppkey AS VARCHAR) AS pitcher,
    CASE WHEN p_size % 25 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END AS batterhand,
    CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS pitcherhand,
    CASE WHEN l_linenumber = 7 THEN 15
         WHEN l_linenumber = 6 AND l_quantity < 10 THEN 0
         WHEN l_linenumber = 5 AND l_quantity > 45 THEN 22
         WHEN l_linenumber = 5 AND l_quantity < 6 THEN 16
         WHEN l_linenumber = 4 AND l_quantity < 4 THEN 99
         WHEN l_linenumber = 3 AND l_quantity < 4 THEN 18
         WHEN l_linenumber = 2 AND l_quantity < 4 THEN 1
         ELSE CASE l_returnflag || l_linestatus WHEN 'AF' THEN 20 WHEN 'AO' THEN 2
           WHEN 'NF' THEN 14 WHEN 'NO' THEN 3 WHEN 'RF' THEN 21 WHEN 'RO' THEN 23 END
    END AS eventtype,
    CASE WHEN l_quantity = 1 THEN 'F' ELSE 'T' END AS battereventflag,
    CASE WHEN l_tax = 0 THEN 'T' ELSE 'F' END AS shflag,
    CASE WHEN l_discount = 0 THEN 'T' ELSE 'F' END AS sfflag,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _case(pairs) -> str:
    return " ".join(f"WHEN {codes} THEN '{name}'" for name, codes in pairs)


def plate(fine: bool = False) -> str:
    none = "eventtype IN (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 24)"
    if fine:
        hit, fly = "SH", "SF"
        pairs = [
            ("BIPOUT", "eventtype IN (2, 19)"), ("K", "eventtype = 3"), ("UBB", "eventtype = 14"),
            ("IBB", "eventtype = 15"), ("HBP", "eventtype = 16"), ("OTHER", "eventtype IN (17, 18)"),
            ("SNGL", "eventtype = 20"), ("DBL", "eventtype = 21"), ("TRPL", "eventtype = 22"),
            ("HR", "eventtype = 23"), ("UNKNOWN", "eventtype = 0"), ("NOBAT", none),
        ]
    else:
        hit, fly = "OTHER", "BIPOUT"
        pairs = [
            ("BIPOUT", "eventtype IN (2, 19)"), ("K", "eventtype = 3"), ("BB", "eventtype IN (14, 16)"),
            ("OTHER", "eventtype IN (15, 17, 18)"), ("SNGL", "eventtype = 20"),
            ("XBH", "eventtype IN (21, 22)"), ("HR", "eventtype = 23"),
            ("UNKNOWN", "eventtype = 0"), ("NOBAT", none),
        ]
    return f"""{PLAYS}, {GAMES}, plate AS (
  SELECT p.*, g.gamesite,
    CASE WHEN sfflag = 'T' THEN '{fly}' WHEN shflag = 'T' THEN '{hit}' {_case(pairs)} END AS event,
    CAST(least((row_number() OVER (PARTITION BY p.gameid, pitcher ORDER BY {ORDER}) - 1) // 9, 2) AS INTEGER) AS timesthrough,
    pitcherhand || batterhand AS pitbathand
  FROM plays p LEFT JOIN games g ON p.gameid = g.gameid
  WHERE battereventflag = 'T')"""


PLATE = plate()
KEPT = f"{PLATE}, kept AS (SELECT * FROM plate WHERE event IS DISTINCT FROM 'OTHER')"


def counts_of(keys: str, source: str, names=SIX) -> str:
    """Count pivot over a source, missing keys and classes left out."""
    present = " AND ".join(f"{key.strip()} IS NOT NULL" for key in keys.split(","))
    cells = ", ".join(f"count(*) FILTER (WHERE event = '{n}') AS n_{n}" for n in names)
    return (
        f"SELECT {keys}, count(*) AS PA, {cells} FROM {source} "
        f"WHERE event IS NOT NULL AND {present} GROUP BY {keys}"
    )


def rates_of(keys: str, source: str, names=SIX) -> str:
    cells = ", ".join(f"n_{n} / CAST(PA AS DOUBLE) AS {n}" for n in names)
    return f"SELECT {keys}, PA, {cells} FROM ({counts_of(keys, source, names)})"


WEIGHTED = {
    "AVG": "(SNGL + XBH + HR) / NULLIF(1 - BB, 0)",
    "OBP": "SNGL + XBH + HR + BB",
    "WOBA": "SNGL * w1B + XBH * (w2B * 0.9 + w3B * (1 - 0.9)) + HR * wHR + BB * (wBB * 0.9 + wHBP * (1 - 0.9))",
    "FIP": "(HR * 13 + BB * 3 - K * 2) / NULLIF(K + BIPOUT, 0) * 3 + cFIP",
}
FIXED = {
    "AVG": "(SNGL + XBH + HR) / NULLIF(SNGL + XBH + HR + K + BIPOUT, 0)",
    "OBP": "(SNGL + XBH + HR + BB) / NULLIF(SNGL + XBH + HR + K + BIPOUT + BB, 0)",
    "WOBA": "(SNGL * 0.89 + XBH * 1.31 + HR * 2.10 + BB * 0.70) / NULLIF(1 - OTHER, 0)",
    "FIP": "(HR * 13 + BB * 3 - K * 2) / NULLIF(K + BIPOUT, 0) * 3 + 3.05",
}


def rounded(names) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 12) AS {n}" for n in names)


def metrics(made: dict, only=None) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 12) AS {n}" for n, e in made.items() if only is None or n in only)


def rate_sql(split: str) -> str:
    return f"""WITH {KEPT}, {CONSTS}, r AS ({rates_of("season, " + split, "kept")})
SELECT r.season, {split}, PA, {rounded(SIX)}, {metrics(WEIGHTED)}
FROM r LEFT JOIN consts c ON r.season = c.Season"""


def fixed_sql(split: str) -> str:
    seven = (*SIX, "OTHER")
    return f"""WITH {PLATE}, r AS ({rates_of("season, " + split, "plate", seven)})
SELECT season, {split}, PA, {rounded(seven)}, {metrics(FIXED)} FROM r"""


def levels(source: str = "kept", splits=MODEL_SPLITS, columns: str = "season, event") -> str:
    """Every event once per split, with its level as text."""
    return " UNION ALL ".join(
        f"SELECT '{s}' AS split, CAST({s} AS VARCHAR) AS level, {columns} FROM {source} WHERE {s} IS NOT NULL"
        for s in splits
    )


FINE_PLATE = plate(fine=True)
FINE_COUNTS = f"""{FINE_PLATE}, fc AS (SELECT season, batter, PA, {", ".join(f"n_{n} AS {n}" for n in FINE)},
  PA - n_UBB - n_HBP - n_IBB - n_SH - n_SF AS AB FROM ({counts_of("season, batter", "plate", FINE)}) WHERE PA >= 10)"""

ALL_RATES = f"rates AS ({rates_of('split, level', '(' + levels() + ')')})"

LEVEL_FREQ = f"""freq AS (SELECT split, level, event, n / CAST(sum(n) OVER (PARTITION BY split, level) AS DOUBLE) AS frac
  FROM (SELECT split, level, event, count(*) AS n FROM ({levels()}) WHERE event IS NOT NULL GROUP BY ALL))"""

LINES = """lines AS (
  SELECT c_name AS Name, CAST(year(o_orderdate) AS INTEGER) AS Season, c_mktsegment AS Team,
    count(*) AS G, CAST(sum(o_orderkey % 5 + 1) AS BIGINT) AS PA, CAST(sum(o_orderkey % 4) AS BIGINT) AS RBI,
    CAST(sum(o_orderkey % 6) AS BIGINT) AS wRC, CAST(sum(o_orderkey % 7 - 3) AS BIGINT) AS wRAA,
    CAST(sum(o_orderkey % 3 - 1) AS BIGINT) AS BsR, sum(o_totalprice % 40 - 20) AS Bat,
    sum(o_totalprice % 30 - 15) AS Def, CAST(sum(o_orderkey % 2) AS BIGINT) AS WAR
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

SUMS = "CAST(sum(G) AS BIGINT) AS G, CAST(sum(PA) AS BIGINT) AS PA, CAST(sum(RBI) AS BIGINT) AS RBI, CAST(sum(wRC) AS BIGINT) AS wRC, CAST(sum(wRAA) AS BIGINT) AS wRAA, CAST(sum(BsR) AS BIGINT) AS BsR, sum(Bat) AS Bat, sum(Bat + BsR) AS \"Off\", sum(Def) AS Def, CAST(sum(WAR) AS BIGINT) AS WAR"
DH = "G * -17.5 / 162 AS DefDH, G * -17.5 / 162 - Def AS DefImp, (G * -17.5 / 162 - Def) * 162 / G AS DefImp162"


def core() -> dict[str, str]:
    sql = {}
    sql["plate_events"] = f"""WITH {PLATE}
SELECT {ORDER}, season, gameid, gamesite, batter, pitcher, batterhand, pitcherhand, event, timesthrough, pitbathand FROM plate"""
    for split in ("batter", "pitcher", "gamesite", "batterhand", "pitcherhand", "timesthrough", "pitbathand"):
        sql[f"rates_by_{split}"] = rate_sql(split)
        sql[f"rates_v1_by_{split}"] = fixed_sql(split)
    sql["rates_two_key"] = fixed_sql("pitcherhand, batterhand")
    sql["rates_all_splits"] = f"WITH {KEPT}, {ALL_RATES} SELECT split, level, PA, {rounded(SIX)} FROM rates"
    sql["rates_fine"] = f"""WITH {FINE_COUNTS} SELECT season, batter, PA, AB, {", ".join(FINE)},
round((SNGL + DBL + TRPL + HR) / CAST(NULLIF(AB, 0) AS DOUBLE), 12) AS BA,
round((SNGL + DBL + TRPL + HR + UBB + IBB + HBP) / CAST(NULLIF(AB + UBB + IBB + HBP + SF, 0) AS DOUBLE), 12) AS OBP,
round(CAST((0.69 * UBB + 0.72 * HBP + 0.89 * SNGL + 1.27 * DBL + 1.62 * TRPL + 2.10 * HR) AS DOUBLE) / CAST(NULLIF(AB + UBB + SF + HBP, 0) AS DOUBLE), 12) AS WOBA FROM fc"""
    shares = {"SNGL": "SNGL", "DBL": "DBL", "TRPL": "TRPL", "HR": "HR", "BB": "UBB + IBB", "HBP": "HBP", "K": "K", "BIPOUT": "BIPOUT + SF"}
    sql["fine_percentages"] = f"""WITH {FINE_COUNTS} SELECT season, batter,
{", ".join(f"round(({e}) / CAST(PA AS DOUBLE), 12) AS {n}" for n, e in shares.items())} FROM fc"""
    sql["event_freq"] = f"""WITH {KEPT} SELECT event, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 12) AS frac
FROM kept WHERE event IS NOT NULL GROUP BY event"""
    sql["event_freq_of_all"] = f"""WITH {PLATE}, c AS (SELECT season, event, count(*) AS n FROM plate GROUP BY ALL)
SELECT * FROM (SELECT season, event, n, round(n / CAST(sum(n) OVER (PARTITION BY season) AS DOUBLE), 12) AS frac FROM c) WHERE event IS NOT NULL"""
    seven = (*SIX, "OTHER")
    sql["event_freq_by_season"] = f"""WITH {PLATE}, r AS ({rates_of("season", "plate", seven)})
SELECT season, {rounded(seven)}, {metrics(FIXED, ("AVG", "OBP", "WOBA"))} FROM r"""
    sql["fip_by_season_tto"] = f"""WITH {KEPT}, {CONSTS}, r AS ({rates_of("season, timesthrough", "kept")}),
f AS (SELECT r.season, timesthrough, {WEIGHTED["FIP"]} AS FIP FROM r LEFT JOIN consts c ON r.season = c.Season)
SELECT season, {", ".join(f'round(max(FIP) FILTER (WHERE timesthrough = {t}), 12) AS tto_{t}' for t in range(3))} FROM f GROUP BY season"""
    sql["meeting_number"] = f"""WITH {PLATE} SELECT {ORDER}, gameid, batter, pitcher,
CAST(row_number() OVER (PARTITION BY gameid, batter, pitcher ORDER BY {ORDER}) - 1 AS BIGINT) AS meeting FROM plate"""
    sql["event_meeting_number"] = """SELECT event_id, user_id, event_type,
CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS meeting FROM events"""
    sql["matchup_counts"] = f"WITH {PLATE} SELECT gameid, batter, pitcher, count(*) AS n FROM plate WHERE gameid IS NOT NULL AND batter IS NOT NULL AND pitcher IS NOT NULL GROUP BY ALL"
    sql["hand_matchup_counts"] = f"""WITH {PLATE} SELECT season, pitbathand, pitcher, count(*) AS n FROM plate
WHERE season IS NOT NULL AND pitbathand IS NOT NULL AND pitcher IS NOT NULL GROUP BY ALL"""
    sql["rates_all_splits_by_season"] = f"""WITH {KEPT}, rates AS ({rates_of("season, split, level", "(" + levels() + ")")})
SELECT season, split, level, PA, {rounded(SIX)} FROM rates"""
    sql["events_nonnull"] = f"WITH {PLATE} SELECT count(event) AS n FROM plate"
    sql["pitches"] = """SELECT l_orderkey AS index, CAST(l_shipdate AS DATE) AS game_date, l_partkey AS batter, l_suppkey AS pitcher,
l_returnflag AS events, CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS p_throws
FROM lineitem WHERE l_quantity <= 12 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1998-04-23'"""
    named = f"{KEPT}, {CONSTS}, people AS (SELECT CAST(s_suppkey AS VARCHAR) AS ID, s_name AS Name FROM supplier WHERE s_suppkey % 7 <> 0), bnames AS (SELECT p_brand AS ID, min(p_name) AS Name FROM part WHERE NOT p_brand LIKE '%5' GROUP BY 1)"
    sql["top_batters"] = f"""WITH {named}, r AS ({rates_of("season, batter", "kept")})
SELECT r.season, batter, Name, PA, round(CAST({WEIGHTED["WOBA"]} AS DOUBLE), 12) AS WOBA
FROM r LEFT JOIN consts c ON r.season = c.Season JOIN bnames b ON r.batter = b.ID
WHERE PA >= 20 ORDER BY WOBA DESC NULLS LAST, r.season, batter LIMIT 20"""
    sql["bottom_pitchers"] = f"""WITH {named}, r AS ({rates_of("season, pitcher", "kept")})
SELECT r.season, pitcher, Name, PA, round(CAST({WEIGHTED["FIP"]} AS DOUBLE), 12) AS FIP
FROM r LEFT JOIN consts c ON r.season = c.Season LEFT JOIN people b ON r.pitcher = b.ID
WHERE PA >= 20 ORDER BY FIP ASC NULLS LAST, r.season, pitcher LIMIT 20"""
    sql["park_rates"] = f"""WITH {KEPT}, {CONSTS}, parks AS (SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS PARKID, n_name AS NAME FROM nation WHERE n_nationkey BETWEEN 1 AND 10),
r AS ({rates_of("season, gamesite", "kept")})
SELECT r.season, gamesite, NAME, PA, {rounded(SIX)}, {metrics(WEIGHTED)}
FROM r LEFT JOIN consts c ON r.season = c.Season LEFT JOIN parks ON gamesite = PARKID"""
    sql["rate_spread"] = f"""WITH {KEPT}, {LEVEL_FREQ}
SELECT split, event, round(var_samp(frac), 12) AS var, round(stddev_samp(frac), 12) AS std FROM freq GROUP BY split, event"""
    sql["level_freq"] = f"WITH {KEPT}, {LEVEL_FREQ} SELECT split, level, event, round(frac, 12) AS frac FROM freq"
    sql["freq_grid"] = f"""WITH {KEPT}, {LEVEL_FREQ}, l AS (SELECT DISTINCT split, level FROM freq),
o(event) AS (VALUES {", ".join(f"('{n}')" for n in SIX)})
SELECT l.split, l.level, o.event, round(coalesce(frac, 0.0), 12) AS frac
FROM l CROSS JOIN o LEFT JOIN freq f ON f.split = l.split AND f.level = l.level AND f.event = o.event"""
    sql["weighted_split_means"] = f"""WITH {KEPT}, {ALL_RATES} SELECT split,
{", ".join(f"round(sum({n} * PA) / sum(PA), 12) AS {n}" for n in SIX)} FROM rates GROUP BY split"""
    sql["rates_long"] = f"WITH {KEPT}, {ALL_RATES} " + " UNION ALL ".join(
        f"SELECT split, level, '{n}' AS event, round(CAST({n} AS DOUBLE), 12) AS value FROM rates" for n in (*SIX, "PA")
    )
    sql["rates_wide"] = f"WITH {KEPT}, {LEVEL_FREQ} SELECT split, level, {', '.join(f'''round(max(frac) FILTER (WHERE event = '{n}'), 12) AS {n}''' for n in SIX)} FROM freq GROUP BY split, level"
    sql["dh_value"] = f"""WITH {LINES}, b AS (SELECT Name, Season, {SUMS} FROM lines WHERE Season BETWEEN 1996 AND 2000 GROUP BY Name, Season HAVING sum(PA) >= 3)
SELECT * FROM (SELECT Name, Season, G, round(Def, 9) AS Def, WAR, round(DefDH, 9) AS DefDH, round(DefImp, 9) AS DefImp, round(DefImp162, 9) AS DefImp162
FROM (SELECT *, {DH} FROM b)) WHERE DefImp > 0 ORDER BY DefImp DESC, Name, Season LIMIT 25"""
    sql["dh_value_career"] = f"""WITH {LINES}, b AS (SELECT Name, {SUMS} FROM lines GROUP BY Name HAVING sum(PA) >= 10)
SELECT Name, G, round(Def, 9) AS Def, WAR, round(DefDH, 9) AS DefDH, round(DefImp, 9) AS DefImp, round(DefImp162, 9) AS DefImp162
FROM (SELECT *, {DH} FROM b) WHERE DefImp > 0"""
    worth = "round(Def, 9) AS Def, WAR, round(DefDH, 9) AS DefDH, round(DefImp, 9) AS DefImp, round(DefImp162, 9) AS DefImp162"
    sql["dh_value_full_season"] = f"""WITH {LINES}, b AS (SELECT Name, Season, {SUMS} FROM lines WHERE Season BETWEEN 1996 AND 2000 GROUP BY Name, Season HAVING sum(PA) >= 3)
SELECT * FROM (SELECT Name, Season, G, {worth} FROM (SELECT *, {DH} FROM b)) WHERE DefImp > 0 ORDER BY DefImp162 DESC, Name, Season LIMIT 25"""
    sql["dh_value_full_career"] = f"""WITH {LINES}, b AS (SELECT Name, {SUMS} FROM lines GROUP BY Name HAVING sum(PA) >= 10)
SELECT * FROM (SELECT Name, G, {worth} FROM (SELECT *, {DH} FROM b)) WHERE DefImp > 0 ORDER BY DefImp162 DESC, Name LIMIT 25"""
    sql["dh_value_ordered"] = f"""WITH {LINES}, b AS (SELECT Name, Season, {SUMS} FROM lines GROUP BY Name, Season)
SELECT Name, Season, G, Def, WAR, DefImp, DefImp162 FROM (SELECT Name, Season, G, {worth} FROM (SELECT *, {DH} FROM b)) WHERE DefImp > 0 ORDER BY DefImp DESC, Name, Season"""
    sql["overrated_by_runs"] = f"""WITH {LINES}, b AS (SELECT Name, Season, {SUMS} FROM lines GROUP BY Name, Season)
SELECT Name, Season, RBI, wRC, WAR, wRC - RBI AS wRC_RBI FROM b ORDER BY wRC_RBI, Name, Season LIMIT 20"""
    sql["overrated"] = f"""WITH {LINES}, b AS (SELECT Name, Season, {SUMS} FROM lines WHERE Team IN ('BUILDING', 'MACHINERY') GROUP BY Name, Season)
SELECT * FROM (SELECT Name, Season, RBI, wRC, wRAA, BsR, round(Bat, 9) AS Bat, round("Off", 9) AS "Off", WAR, wRC - RBI AS wRC_RBI, wRAA - RBI AS wRAA_RBI,
round(Bat - RBI, 9) AS Bat_RBI, round("Off" - RBI, 9) AS Off_RBI FROM b) ORDER BY Bat_RBI, Name, Season LIMIT 20"""
    sql["pa_check"] = f"""WITH {FINE_COUNTS} SELECT season, batter, PA, AB, SNGL + DBL + TRPL + HR + UBB + IBB + IBB + K + HBP + SF + SH AS xPA FROM fc"""
    return sql


MEANS = "means AS (SELECT {} FROM kept)".format(
    ", ".join(f"count(*) FILTER (WHERE event = '{e}') / CAST(count(event) AS DOUBLE) AS m_{e}" for e in SIX)
)
ROWS = "{kept}, {means}, tally AS (SELECT split, level, count(*) AS n, {cells} FROM ({levels}) GROUP BY split, level)".format(
    kept=KEPT, means=MEANS, levels=levels(),
    cells=", ".join(f"count(*) FILTER (WHERE event = '{e}') AS c_{e}" for e in SIX),
)
NARROW = (0.99999, 0.000002)


def log_odds(p) -> str:
    return f"ln({p} / (1 - {p}))"


HIGH, LOW = (log_odds(f"CAST({value} AS DOUBLE)") for value in NARROW)
SHARE_EFFECTS = "eff AS (SELECT split, level, n, {} FROM tally, means)".format(
    ", ".join(f"(c_{e} - n * m_{e}) / (n + 100) AS b_{e}" for e in SIX)
)
LOGIT_EFFECTS = "eff AS (SELECT split, level, n, {} FROM tally, means)".format(
    ", ".join(f"(c_{e} * {HIGH} + (n - c_{e}) * {LOW} - n * {log_odds('m_' + e)}) / (n + 100) AS b_{e}" for e in SIX)
)
SEASON_EFFECTS = "{kept}, means AS (SELECT season, {means} FROM kept WHERE season IS NOT NULL GROUP BY season), tally AS (SELECT season, split, level, count(*) AS n, count(event) AS PA, {cells} FROM ({levels}) WHERE season IS NOT NULL GROUP BY season, split, level), eff AS (SELECT season, split, level, PA, {effects} FROM tally JOIN means USING (season))".format(
    kept=KEPT, levels=levels(),
    means=", ".join(f"count(*) FILTER (WHERE event = '{e}') / CAST(count(event) AS DOUBLE) AS m_{e}" for e in SIX),
    cells=", ".join(f"count(*) FILTER (WHERE event = '{e}') AS c_{e}" for e in SIX),
    effects=", ".join(f"m_{e}, (c_{e} - n * m_{e}) / (n + 100) AS b_{e}" for e in SIX),
)
EST = "est AS (SELECT split, level, {} FROM eff, means)".format(", ".join(f"b_{e} + m_{e} AS {e}" for e in SIX))
SHRUNK = f"{ROWS}, {SHARE_EFFECTS}, {EST}"
OBS = ALL_RATES
EST_LONG = " UNION ALL ".join(f"SELECT split, level, '{e}' AS event, {e} AS value FROM est" for e in SIX)
OBS_LONG = " UNION ALL ".join(f"SELECT split, level, PA, '{e}' AS event, {e} AS value FROM rates" for e in SIX)


def nine(pairs) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 9) AS {n}" for n, e in pairs)


def histogram_sql(bins: int, amount: str, zero: str, source: str = f"{KEPT}, {OBS}, v AS ({OBS_LONG})") -> str:
    return f"""WITH {source},
g AS (SELECT split, event, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM v GROUP BY split, event),
f AS (SELECT v.split, v.event, least(CAST(floor((value - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin, {amount} AS amount
  FROM v JOIN g ON v.split = g.split AND v.event = g.event GROUP BY ALL)
SELECT g.split, g.event, CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / {bins} * i, 12) AS lo,
  round(lo + (hi - lo) / {bins} * (i + 1), 12) AS hi, coalesce(amount, {zero}) AS amount
FROM g CROSS JOIN range({bins}) r(i) LEFT JOIN f ON g.split = f.split AND g.event = f.event AND f.bin = i"""


def board_sql(split: str, names: str, columns: str, tail: str) -> str:
    """Estimates of one split with the weights of season 2000."""
    return f"""WITH {SHRUNK}, {OBS}, {CONSTS}, people AS ({names}),
b AS (SELECT e.level AS {split}, p.Name, r.PA, {", ".join("e." + x for x in SIX)}, c.* EXCLUDE (Season)
  FROM est e JOIN rates r ON e.split = r.split AND e.level = r.level LEFT JOIN people p ON e.level = p.ID
  CROSS JOIN (SELECT * FROM consts WHERE Season = 2000) c WHERE e.split = '{split}')
SELECT * FROM (SELECT {split}, {columns} FROM b {tail}"""


def season_board_sql(split: str, metric: str, order: str) -> str:
    """The first five of every season by estimates with the season's own weights."""
    return f"""WITH {SEASON_EFFECTS}, {CONSTS},
est AS (SELECT season, level AS {split}, PA, {", ".join(f"b_{e} + m_{e} AS {e}" for e in SIX)} FROM eff WHERE split = '{split}'),
b AS (SELECT e.season, {split}, PA, {nine((e, e) for e in SIX)}, {nine(WEIGHTED.items())} FROM est e LEFT JOIN consts c ON e.season = c.Season WHERE PA >= 20),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY {metric} {order} NULLS LAST, {split}) AS INTEGER) AS place FROM b)
SELECT * FROM p WHERE place <= 5"""


def models() -> dict[str, str]:
    sql = {}
    sql["shrunk_by_season"] = f"WITH {SEASON_EFFECTS} SELECT season, split, level, {nine((e, 'b_' + e) for e in SIX)} FROM eff"
    sql["ridge_by_season"] = f"WITH {SEASON_EFFECTS} SELECT season, split, level, " + ", ".join(
        f"round(b_{e}, 7) AS {e}" for e in SIX
    ) + " FROM eff WHERE split = 'batter'"
    sql["est_top_batters_by_season"] = season_board_sql("batter", "WOBA", "DESC")
    sql["est_bottom_pitchers_by_season"] = season_board_sql("pitcher", "FIP", "ASC")
    sql["hexbins"] = f"""WITH {KEPT}, {OBS}, v AS (SELECT split, round(SNGL, 9) AS x, round(HR, 9) AS y FROM rates),
g AS (SELECT split, min(x) AS xlo, (max(x) - min(x)) / 9 AS w, min(y) AS ylo, (max(y) - min(y)) / 5 AS h FROM v GROUP BY split),
c AS (SELECT v.split, xlo, ylo, w, h, (x - xlo) / w AS u, (y - ylo) / h AS v FROM v JOIN g ON v.split = g.split),
d AS (SELECT *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS near FROM c),
n AS (SELECT *, CASE WHEN near THEN 0 ELSE 1 END AS lattice, CASE WHEN near THEN 0.0 ELSE 0.5 END AS half FROM d),
i AS (SELECT *, CAST(floor(u + 0.5 - half) AS INTEGER) AS x_no, CAST(floor(v + 0.5 - half) AS INTEGER) AS y_no FROM n)
SELECT split, lattice, x_no, y_no, round(min(xlo + w * (x_no + half)), 9) AS x, round(min(ylo + h * (y_no + half)), 9) AS y, count(*) AS n
FROM i GROUP BY split, lattice, x_no, y_no"""
    pairs = []
    for s in MODEL_SPLITS:
        for t in MODEL_SPLITS:
            pairs.append(
                f"SELECT '{s}' AS split, CAST({s} AS VARCHAR) AS level, '{t}' AS split2, CAST({t} AS VARCHAR) AS level2, count(*) AS n "
                f"FROM kept WHERE {s} IS NOT NULL AND {t} IS NOT NULL GROUP BY ALL"
            )
    sql["gram"] = f"WITH {KEPT} " + " UNION ALL ".join(pairs)
    sql["xty"] = f"WITH {ROWS} " + " UNION ALL ".join(
        f"SELECT split, level, '{e}' AS event, round(c_{e} - n * m_{e}, 6) AS value FROM tally, means" for e in SIX
    )
    sql["long_design"] = f"WITH {KEPT} SELECT {ORDER}, split, level FROM ({levels(columns=ORDER)})"
    sql["centred_outcomes"] = f"WITH {KEPT}, {MEANS} SELECT {ORDER}, " + nine(
        (e, f"CASE WHEN event = '{e}' THEN 1.0 ELSE 0.0 END - m_{e}") for e in SIX
    ) + " FROM kept, means"
    sql["logit_outcomes"] = f"WITH {KEPT}, {MEANS} SELECT {ORDER}, " + nine(
        (e, f"CASE WHEN event = '{e}' THEN {HIGH} ELSE {LOW} END - {log_odds('m_' + e)}") for e in SIX
    ) + " FROM kept, means"
    freq = f"{KEPT}, f AS (SELECT event, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS frac FROM kept WHERE event IS NOT NULL GROUP BY event)"
    sql["class_weights"] = f"WITH {freq} SELECT event, n, round(frac, 12) AS frac, round(sqrt(frac / (1 - frac)), 12) AS w FROM f"
    sql["balanced_weights"] = f"WITH {freq} SELECT event, n, round(frac, 12) AS frac, round(1 / (frac * count(*) OVER ()), 12) AS w FROM f"
    sql["shrunk_means"] = f"WITH {ROWS}, {SHARE_EFFECTS} SELECT split, level, {nine((e, 'b_' + e) for e in SIX)} FROM eff"
    sql["ridge_single_split"] = f"WITH {ROWS}, {SHARE_EFFECTS} SELECT split, level, " + ", ".join(
        f"round(b_{e}, 7) AS {e}" for e in SIX
    ) + " FROM eff WHERE split = 'batter'"
    for key in ("ridge_check", "ridge_logit_check", "minnorm_check", "tau_check", "lasso_check", "ols_fit"):
        sql[key] = f"WITH {ROWS} SELECT split, level, n, true AS ok FROM tally"
    present = f"SELECT split, level, count(*) AS n, true AS ok FROM ({levels()}) WHERE event IS NOT NULL"
    sql["logistic_check"] = f"WITH {KEPT} {present} AND split IN ('batter', 'pitcher') GROUP BY split, level"
    sql["weighted_logistic_check"] = f"WITH {KEPT} {present} GROUP BY split, level"
    # splits without missing levels add up to the same column: each but one of them takes a rank
    sql["gram_rank"] = f"""WITH {ROWS}, whole AS (SELECT split FROM tally GROUP BY split HAVING sum(n) = (SELECT count(*) FROM kept))
SELECT count(*) AS p, count(*) - (SELECT count(*) - 1 FROM whole) AS rank FROM tally"""
    sql["logistic_shares"] = f"""WITH {KEPT} SELECT event, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 5) AS share
FROM kept WHERE event IS NOT NULL GROUP BY event"""
    pull = {e: f"(c_{e} * {HIGH} + (n - c_{e}) * {LOW} - n * {log_odds('m_' + e)})" for e in SIX}
    sql["lasso_single_split"] = f"WITH {ROWS} SELECT split, level, " + ", ".join(
        f"round(sign({x}) * greatest(abs({x}) - 0.005 * (SELECT count(*) FROM kept), 0) / n, 5) AS {e}" for e, x in pull.items()
    ) + " FROM tally, means WHERE split = 'batter'"
    sql["estimates_share"] = f"WITH {SHRUNK} SELECT split, level, {nine((e, e) for e in SIX)}, round({' + '.join(SIX)}, 9) AS SUM FROM est"
    back = ", ".join(f"1 / (1 + exp(-(b_{e} + {log_odds('m_' + e)}))) AS {e}" for e in SIX)
    sql["estimates_logit"] = f"WITH {ROWS}, {LOGIT_EFFECTS}, p AS (SELECT split, level, {back} FROM eff, means) SELECT split, level, " + nine(
        (e, f"{e} / ({' + '.join(SIX)})") for e in SIX
    ) + " FROM p"
    sql["estimates_odds"] = f"WITH {ROWS}, {LOGIT_EFFECTS} " + " UNION ALL ".join(
        f"SELECT split, '{e}' AS event, round(avg(exp(b_{e}) * m_{e} / (1 - m_{e})), 9) AS mean FROM eff, means GROUP BY split" for e in SIX
    )
    both = f"WITH {SHRUNK}, {OBS} "
    joined = "FROM rates r JOIN est e ON r.split = e.split AND r.level = e.level"
    sql["est_vs_obs"] = f"{both} SELECT r.split, r.level, PA, {nine((e + '_obs', 'r.' + e) for e in SIX)}, {nine((e + '_est', 'e.' + e) for e in SIX)} {joined}"
    sql["est_vs_obs_long"] = both + " UNION ALL ".join(
        f"SELECT r.split, r.level, '{e}' AS event, round(r.{e}, 9) AS obs, round(e.{e}, 9) AS est, PA {joined}" for e in SIX
    )
    spread = f"SELECT split, event, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS var FROM ({EST_LONG}) GROUP BY split, event"
    sql["est_spread"] = f"WITH {SHRUNK} SELECT split, event, {nine((x, x) for x in ('mean', 'std', 'var'))} FROM ({spread})"
    sql["est_shrinkage"] = f"""WITH {SHRUNK}, {LEVEL_FREQ}, e AS ({spread}), o AS (SELECT split, event, var_samp(frac) AS var FROM freq GROUP BY split, event)
SELECT e.split, round(avg(e.var / o.var), 9) AS ratio FROM e JOIN o ON e.split = o.split AND e.event = o.event GROUP BY e.split"""
    sql["mean_fitted"] = f"{both} SELECT r.split, {nine((e, f'sum(e.{e} * PA) / sum(PA)') for e in SIX)} {joined} GROUP BY r.split"
    each = " ".join(
        f"LEFT JOIN (SELECT * FROM eff WHERE split = '{s}') e_{s} ON CAST(k.{s} AS VARCHAR) = e_{s}.level" for s in MODEL_SPLITS
    )
    sql["fitted_values"] = f"WITH {ROWS}, {SHARE_EFFECTS} SELECT {ORDER}, " + nine(
        (e, " + ".join(f"coalesce(e_{s}.b_{e}, 0)" for s in MODEL_SPLITS)) for e in SIX
    ) + f" FROM kept k {each}"
    star = " ".join(
        f"LEFT JOIN (SELECT * FROM rates WHERE split = '{s}') r_{s} ON CAST(k.{s} AS VARCHAR) = r_{s}.level" for s in MODEL_SPLITS
    )
    sql["star_rates"] = f"WITH {KEPT}, {OBS} SELECT {ORDER}, event, " + ", ".join(
        f"round(r_{s}.{e}, 12) AS {s}_{e}" for s in MODEL_SPLITS for e in SIX
    ) + f" FROM kept k {star}"
    six = nine((e, e) for e in SIX)
    made = nine(WEIGHTED.items())
    sql["est_top_batters"] = board_sql(
        "batter", "SELECT p_brand AS ID, min(p_name) AS Name FROM part WHERE NOT p_brand LIKE '%5' GROUP BY 1",
        f"Name, PA, {six}, {made}", "WHERE PA >= 100) ORDER BY WOBA DESC NULLS LAST, batter LIMIT 10",
    )
    sql["est_bottom_pitchers"] = board_sql(
        "pitcher", "SELECT CAST(s_suppkey AS VARCHAR) AS ID, s_name AS Name FROM supplier WHERE s_suppkey % 7 <> 0",
        f"Name, PA, {six}, {made}", "WHERE PA >= 100) ORDER BY FIP NULLS LAST, pitcher LIMIT 10",
    )
    sql["est_parks"] = board_sql(
        "gamesite", "SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS ID, n_name AS Name FROM nation WHERE n_nationkey BETWEEN 1 AND 10",
        f"Name AS NAME, {six}, {nine((m, WEIGHTED[m]) for m in ('WOBA', 'FIP'))}", ")",
    )
    sql["hist"] = histogram_sql(10, "count(*)", "0")
    sql["weighted_hist"] = histogram_sql(50, "CAST(sum(PA) AS DOUBLE)", "0.0")
    nine_digits = " UNION ALL ".join(f"SELECT split, level, '{e}' AS event, round(CAST({e} AS DOUBLE), 9) AS value FROM est" for e in SIX)
    sql["hist_estimates"] = histogram_sql(10, "count(*)", "0", f"{SHRUNK}, v AS ({nine_digits})")
    sql["bins2d"] = f"""WITH {KEPT}, {OBS}, v AS (SELECT split, round(SNGL, 9) AS x, round(HR, 9) AS y FROM rates),
g AS (SELECT split, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM v GROUP BY split)
SELECT v.split, least(CAST(floor((x - xlo) / (xhi - xlo) * 8) AS INTEGER), 7) AS x_bin,
  least(CAST(floor((y - ylo) / (yhi - ylo) * 8) AS INTEGER), 7) AS y_bin, count(*) AS n
FROM v JOIN g ON v.split = g.split GROUP BY ALL"""
    sql["kde2d"] = f"""WITH {KEPT}, {OBS}, v AS (SELECT split, SNGL AS px, HR AS py, PA FROM rates),
g AS (SELECT split, min(px) AS xlo, max(px) AS xhi, min(py) AS ylo, max(py) AS yhi FROM v GROUP BY split),
s AS (SELECT g.split, i AS x_no, j AS y_no, xlo + (xhi - xlo) / 11 * i AS x, ylo + (yhi - ylo) / 11 * j AS y FROM g CROSS JOIN range(12) a(i) CROSS JOIN range(12) b(j))
SELECT s.split, CAST(x_no AS INTEGER) AS x_no, CAST(y_no AS INTEGER) AS y_no, round(x, 9) AS x, round(y, 9) AS y,
  round(sum(PA * exp(-(pow(px - x, 2) + pow(py - y, 2)) / (2 * pow(CAST(0.02 AS DOUBLE), 2)))) / sum(PA) / (2 * pow(CAST(0.02 AS DOUBLE), 2)) / pi(), 9) AS density
FROM s JOIN v ON s.split = v.split GROUP BY s.split, x_no, y_no, x, y"""
    sql["binned_density"] = f"""WITH {KEPT}, {OBS}, v AS (SELECT split, round(SNGL, 9) AS px, round(HR, 9) AS py, PA FROM rates WHERE SNGL IS NOT NULL AND HR IS NOT NULL),
r AS (SELECT split, min(px) AS xlo, (max(px) - min(px)) / 11 AS xstep, min(py) AS ylo, (max(py) - min(py)) / 11 AS ystep, sum(PA) AS whole FROM v GROUP BY split),
g AS (SELECT *, ceil(xstep * 16 / CAST(0.02 AS DOUBLE)) AS xparts, ceil(ystep * 16 / CAST(0.02 AS DOUBLE)) AS yparts FROM r),
p AS (SELECT v.split, PA, (px - xlo) / (xstep / xparts) AS u, (py - ylo) / (ystep / yparts) AS w FROM v JOIN g ON v.split = g.split),
d AS (SELECT split, floor(u) + i AS a, floor(w) + j AS b,
  sum(PA * CASE WHEN i = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END * CASE WHEN j = 0 THEN 1 - (w - floor(w)) ELSE w - floor(w) END) AS amount
  FROM p CROSS JOIN range(2) s(i) CROSS JOIN range(2) t(j) GROUP BY ALL),
s AS (SELECT g.*, i AS x_no, j AS y_no FROM g CROSS JOIN range(12) a(i) CROSS JOIN range(12) b(j))
SELECT s.split, CAST(x_no AS INTEGER) AS x_no, CAST(y_no AS INTEGER) AS y_no, round(min(xlo + xstep * x_no), 8) AS x, round(min(ylo + ystep * y_no), 8) AS y,
  round(coalesce(sum(amount * exp(-pow((a - x_no * xparts) * (xstep / xparts), 2) / (2 * pow(CAST(0.02 AS DOUBLE), 2)))
    * exp(-pow((b - y_no * yparts) * (ystep / yparts), 2) / (2 * pow(CAST(0.02 AS DOUBLE), 2)))), 0) / min(whole) / (2 * pow(CAST(0.02 AS DOUBLE), 2)) / pi(), 8) AS density
FROM s LEFT JOIN d ON s.split = d.split AND abs(a - x_no * xparts) <= floor(6 * CAST(0.02 AS DOUBLE) / (xstep / xparts))
  AND abs(b - y_no * yparts) <= floor(6 * CAST(0.02 AS DOUBLE) / (ystep / yparts))
GROUP BY s.split, x_no, y_no"""
    return sql


def pages() -> dict[str, str]:
    sql = {}
    cells = """c AS (SELECT c_custkey // 50 AS page_id, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) + 3 AS INTEGER) AS row_no,
  c_custkey % 50 AS place, * FROM customer)"""
    parts = (
        ("#", "CAST(place AS VARCHAR)", "true"), ("Name", "c_name", "true"),
        ("Nation", "CAST(c_nationkey AS VARCHAR)", "true"), ("Segment", "'A&B ' || c_mktsegment", "true"),
        ("Balance", "CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)", "place % 10 <> 0"),
    )
    long = " UNION ALL ".join(
        f"SELECT page_id, row_no, {i} AS col_no, '{name}' AS header, {value} AS cell FROM c WHERE {there}"
        for i, (name, value, there) in enumerate(parts, 1)
    )
    sql["html_cells"] = sql["html_promoted"] = f"WITH {cells} {long}"
    sql["html_table"] = f"""WITH {cells} SELECT page_id, row_no, CAST(place AS DOUBLE) AS "#", c_name AS Name,
CAST(c_nationkey AS DOUBLE) AS Nation, 'A&B ' || c_mktsegment AS Segment, CASE WHEN place % 10 <> 0 THEN floor(c_acctbal) END AS Balance FROM c"""
    mixed = "CASE WHEN c_custkey % 10 = 0 THEN '--' ELSE CAST(c_nationkey AS VARCHAR) END"
    sql["coerced_columns"] = f"SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS number, {mixed} AS mixed, c_name AS word FROM customer"
    sql["coerced_cells"] = f"SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS number, TRY_CAST({mixed} AS DOUBLE) AS mixed, TRY_CAST(c_name AS DOUBLE) AS word FROM customer"
    return sql


def oracle_sql() -> dict[str, str]:
    return {**core(), **models(), **pages()}
