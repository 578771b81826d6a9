"""Rate metrics as column expressions over outcome rates or counts.

Divisions give NULL, not an error or infinity, when the divisor is zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run weights for the two metrics that do not use season weights.
FIXED_WOBA = {"SNGL": 0.89, "XBH": 1.31, "HR": 2.10, "BB": 0.70}
FINE_WOBA = {"UBB": 0.69, "HBP": 0.72, "SNGL": 0.89, "DBL": 1.27, "TRPL": 1.62, "HR": 2.10}
FIXED_FIP_CONSTANT = 3.05
# Share of doubles in extra-base hits and of walks in free passes.
DOUBLE_SHARE, WALK_SHARE = 0.9, 0.9

#: season columns the weighted metrics read
SEASON_WEIGHTS = ("wBB", "wHBP", "w1B", "w2B", "w3B", "wHR", "cFIP")


def _total(*names: str) -> Column:
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def _fip_core() -> Column:
    runs = F.col("HR") * 13 + F.col("BB") * 3 - F.col("K") * 2
    return F.try_divide(runs, _total("K", "BIPOUT")) * 3


def rates(outcomes) -> dict[str, Column]:
    return {name: F.try_divide(F.col(name), F.col("PA")) for name in outcomes}


def weighted_metrics() -> dict[str, Column]:
    """AVG, OBP, WOBA, FIP from six rates and the season's weights."""
    xbh = F.col("w2B") * DOUBLE_SHARE + F.col("w3B") * (1 - DOUBLE_SHARE)
    free = F.col("wBB") * WALK_SHARE + F.col("wHBP") * (1 - WALK_SHARE)
    return {
        "AVG": F.try_divide(_total("SNGL", "XBH", "HR"), 1 - F.col("BB")),
        "OBP": _total("SNGL", "XBH", "HR", "BB"),
        "WOBA": F.col("SNGL") * F.col("w1B")
        + F.col("XBH") * xbh
        + F.col("HR") * F.col("wHR")
        + F.col("BB") * free,
        "FIP": _fip_core() + F.col("cFIP"),
    }


def fixed_metrics() -> dict[str, Column]:
    """AVG, OBP, WOBA, FIP from seven rates (OTHER kept) and fixed weights."""
    at_bats = _total("SNGL", "XBH", "HR", "K", "BIPOUT")
    runs = sum(F.col(name) * weight for name, weight in FIXED_WOBA.items())
    return {
        "AVG": F.try_divide(_total("SNGL", "XBH", "HR"), at_bats),
        "OBP": F.try_divide(_total("SNGL", "XBH", "HR", "BB"), at_bats + F.col("BB")),
        "WOBA": F.try_divide(runs, 1 - F.col("OTHER")),
        "FIP": _fip_core() + FIXED_FIP_CONSTANT,
    }


def at_bats() -> Column:
    return F.col("PA") - _total("UBB", "HBP", "IBB", "SH", "SF")


def fine_metrics() -> dict[str, Column]:
    """BA, OBP, WOBA from counts of the fine classes and AB."""
    hits = _total("SNGL", "DBL", "TRPL", "HR")
    runs = sum(F.col(name) * weight for name, weight in FINE_WOBA.items())
    return {
        "BA": F.try_divide(hits, F.col("AB")),
        "OBP": F.try_divide(
            hits + _total("UBB", "IBB", "HBP"), _total("AB", "UBB", "IBB", "HBP", "SF")
        ),
        "WOBA": F.try_divide(runs, _total("AB", "UBB", "SF", "HBP")),
    }


def fine_percentages() -> dict[str, Column]:
    """Shares of PA with both walk kinds joined and sacrifice flies as outs."""
    counts = {
        "SNGL": F.col("SNGL"),
        "DBL": F.col("DBL"),
        "TRPL": F.col("TRPL"),
        "HR": F.col("HR"),
        "BB": _total("UBB", "IBB"),
        "HBP": F.col("HBP"),
        "K": F.col("K"),
        "BIPOUT": _total("BIPOUT", "SF"),
    }
    return {name: F.try_divide(count, F.col("PA")) for name, count in counts.items()}


# A full season's games and the runs a designated hitter costs over it.
FULL_SEASON_GAMES, DH_RUNS = 162, -17.5


def dh_metrics() -> dict[str, Column]:
    """Fielding runs against a designated hitter's, total and per full season."""
    dh = F.col("G") * DH_RUNS / FULL_SEASON_GAMES
    gain = dh - F.col("Def")
    return {
        "DefDH": dh,
        "DefImp": gain,
        "DefImp162": F.try_divide(gain * FULL_SEASON_GAMES, F.col("G")),
    }


def overrated_metrics() -> dict[str, Column]:
    """How far run-production measures fall short of runs batted in."""
    return {f"{name}_RBI": F.col(name) - F.col("RBI") for name in ("wRC", "wRAA", "Bat", "Off")}


def expected_pa() -> Column:
    """PA rebuilt from its parts; IBB counts on top of BB, outs in play do not."""
    parts = ("1B", "2B", "3B", "HR", "BB", "IBB", "SO", "HBP", "SF", "SH")
    return _total(*(f"`{name}`" for name in parts))
