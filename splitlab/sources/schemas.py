"""Declared schemas of the inputs; nothing is inferred from data."""

from __future__ import annotations

GAMES = "gameid STRING, date STRING, hometeam STRING, awayteam STRING, gamesite STRING"
PLAYS = (
    "gameid STRING, inning INT, battingteam INT, outs INT, batter STRING, batterhand STRING, "
    "pitcher STRING, pitcherhand STRING, eventtext STRING, eventtype INT, "
    "battereventflag STRING, abflag STRING, hitvalue INT, shflag STRING, sfflag STRING, "
    "outsonplay INT"
)
SEASON_CONSTANTS = (
    "Season INT, wOBA DOUBLE, wOBAScale DOUBLE, wBB DOUBLE, wHBP DOUBLE, w1B DOUBLE, "
    "w2B DOUBLE, w3B DOUBLE, wHR DOUBLE, runSB DOUBLE, runCS DOUBLE, `R/PA` DOUBLE, "
    "`R/W` DOUBLE, cFIP DOUBLE"
)
PARKS = (
    "PARKID STRING, NAME STRING, AKA STRING, CITY STRING, STATE STRING, START STRING, "
    "END STRING, LEAGUE STRING, NOTES STRING"
)
PITCH_COLUMNS = (
    "index", "game_date", "batter", "pitcher", "events", "stand", "p_throws", "home_team",
    "away_team",
)


def column_names(ddl: str) -> list[str]:
    return [part.strip().rsplit(" ", 1)[0].strip("`") for part in ddl.split(",")]
