"""From many headerless extract files to one season-partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlab.sources import schemas

# The fields of the full game and play extracts that are kept,
# by position, in the order of the output columns.
GAME_FIELDS = (0, 1, 8, 7, 9)
PLAY_FIELDS = (0, 2, 3, 4, 10, 11, 14, 15, 29, 34, 35, 36, 37, 38, 39, 40)

#: a season is the first four digits of a file name
SEASON_PATTERN = r"(\d{4})"
SEASON_FILES = "*.EV*"


def _scan(
    spark: SparkSession, folder: str, fields, names: list[str], pattern: str, quote: str
) -> DataFrame:
    """Positional CSV read of the files matching a name pattern, in text columns."""
    width = max(fields) + 1
    schema = ", ".join(f"_c{i} STRING" for i in range(width))
    rows = (
        spark.read.schema(schema)
        .option("header", False)
        .option("quote", quote)
        .option("escape", quote)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    picked = [F.col(f"_c{position}").alias(name) for position, name in zip(fields, names)]
    season = F.regexp_extract(F.col("_metadata.file_name"), SEASON_PATTERN, 1).cast("int")
    return rows.select(
        *picked,
        season.alias("season"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _file_order() -> Column:
    """A number that grows along a file: start of the row's block plus row count.

    A scan task takes at most one block's length of bytes, so it counts fewer
    rows than bytes up to the next block of the file, and numbers never meet.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return F.col("_start") + row_in_task


def _typed(rows: DataFrame, ddl: str) -> DataFrame:
    kinds = dict(part.strip().rsplit(" ", 1) for part in ddl.split(","))
    return rows.withColumns({name: F.col(name).try_cast(kind) for name, kind in kinds.items()})


def scan_plays(
    spark: SparkSession,
    folder: str,
    fields=None,
    pattern: str = SEASON_FILES + ".csv",
    quote: str = '"',
) -> DataFrame:
    """Plays of all files with ``season``, ``source_file`` and ``event_seq``.

    ``fields`` are the positions to keep; by default the files hold exactly the
    kept fields. ``event_seq`` follows file order within ``source_file``; write
    the table before using it, so that the order is fixed.
    """
    names = schemas.column_names(schemas.PLAYS)
    rows = _scan(spark, folder, fields or range(len(names)), names, pattern, quote)
    return _typed(rows.withColumn("event_seq", _file_order()).drop("_start"), schemas.PLAYS)


def scan_games(
    spark: SparkSession,
    folder: str,
    fields=None,
    pattern: str = SEASON_FILES + ".csv",
    quote: str = '"',
) -> DataFrame:
    names = schemas.column_names(schemas.GAMES)
    rows = _scan(spark, folder, fields or range(len(names)), names, pattern, quote)
    return _typed(rows.drop("_start"), schemas.GAMES)


def write_seasons(table: DataFrame, path: str) -> None:
    """Season-partitioned parquet; a season written again replaces only itself.

    Rows go to their season's files straight from the scan: no shuffle, so that
    one large season is written by many tasks.
    """
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("season")
        .parquet(path)
    )


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
