"""Outcome classes of a play, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The play codes behind each outcome class. Codes 1, 4-13 and 24
# are plays without a batting outcome.
NO_OUTCOME_CODES = (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 24)

COARSE_CODES = {
    "UNKNOWN": (0,),
    "NOBAT": NO_OUTCOME_CODES,
    "BIPOUT": (2, 19),
    "K": (3,),
    "BB": (14, 16),
    "OTHER": (15, 17, 18),
    "SNGL": (20,),
    "XBH": (21, 22),
    "HR": (23,),
}

FINE_CODES = {
    "UNKNOWN": (0,),
    "NOBAT": NO_OUTCOME_CODES,
    "BIPOUT": (2, 19),
    "K": (3,),
    "UBB": (14,),
    "IBB": (15,),
    "HBP": (16,),
    "OTHER": (17, 18),
    "SNGL": (20,),
    "DBL": (21,),
    "TRPL": (22,),
    "HR": (23,),
}

# The outcomes that get a rate column.
OUTCOMES = ("SNGL", "XBH", "HR", "BB", "K", "BIPOUT")
FINE_OUTCOMES = (
    "SNGL", "DBL", "TRPL", "HR", "UBB", "IBB", "HBP", "K", "SF", "SH", "BIPOUT", "OTHER",
)

#: class given to sacrifice hits and sacrifice flies in each vocabulary
SACRIFICES = {"coarse": ("OTHER", "BIPOUT"), "fine": ("SH", "SF")}


def classify(vocabulary: str = "coarse") -> Column:
    """Outcome class from ``eventtype`` and the two sacrifice flags.

    A sacrifice fly wins over a sacrifice hit when both flags are set; a code
    outside the vocabulary gives NULL.
    """
    if vocabulary not in SACRIFICES:
        raise ValueError(f"vocabulary must be one of {sorted(SACRIFICES)}, not {vocabulary!r}")
    codes = COARSE_CODES if vocabulary == "coarse" else FINE_CODES
    hit, fly = SACRIFICES[vocabulary]
    # a folded map literal: one lookup, where a long CASE would be copied into every predicate
    pairs = [f"{code}, '{name}'" for name, listed in codes.items() for code in listed]
    known = F.expr(f"map({', '.join(pairs)})")[F.col("eventtype")]
    return F.when(F.col("sfflag") == "T", fly).when(F.col("shflag") == "T", hit).otherwise(known)


def hand_matchup() -> Column:
    """Pitcher's hand then batter's hand; NULL when either is missing."""
    return F.concat("pitcherhand", "batterhand")


def full_name() -> Column:
    return F.concat("First", F.lit(" "), "Last")


def not_other(event: str = "event") -> Column:
    """Drops OTHER but, unlike ``!=`` in SQL, keeps rows without a class."""
    return ~F.col(event).eqNullSafe("OTHER")
