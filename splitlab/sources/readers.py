"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlab.functions.outcomes import full_name
from splitlab.sources import schemas


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A headered CSV; a byte-order mark is skipped, missing tail fields are NULL."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if schema:
        reader = reader.schema(schema).option("enforceSchema", True)
    return reader.csv(path)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.GAMES)


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    """Plays of a headered CSV as they stand; ``event_seq`` comes from ingest."""
    return read_csv_table(spark, path, schemas.PLAYS)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """ID and full name, columns found by header name, any others ignored."""
    people = read_csv_table(spark, path)
    return people.select("ID", "First", "Last", full_name().alias("Name"))


def read_season_constants(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.SEASON_CONSTANTS)


def read_parks(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.PARKS)


def read_seasons(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """A season-partitioned table; the season range prunes folders, not rows."""
    table = spark.read.parquet(path)
    if first is not None:
        table = table.filter(F.col("season") >= first)
    if last is not None:
        table = table.filter(F.col("season") <= last)
    return table


def pitches_between(pitches: DataFrame, start: str, end: str) -> DataFrame:
    """Pitches that ended a plate appearance within two inclusive dates."""
    dated = F.col("game_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return pitches.filter(dated & F.col("events").isNotNull()).select(*schemas.PITCH_COLUMNS)
