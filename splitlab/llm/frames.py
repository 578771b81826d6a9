"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlab.session import written

#: ASCII space and the control characters from tab to carriage return separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that goes to Python; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROW = (1 << 33) - 1


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else the frame holds.

    Names that differ only by case, or that occur twice, do not clash: columns are taken by position and
    the first exact match wins.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([plain[f"c{df.columns.index(name)}"].alias(name) for name in names])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0, c1, … so that working columns cannot clash, and the old names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def _tidy(work):
    """``work`` that gives memory back to the machine after its partition, as Spark keeps workers for later ones."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def in_batches(rows: DataFrame, work, schema, arrow: bool = False) -> DataFrame:
    """``mapInPandas`` (or ``mapInArrow``) in batches of few megabytes, unless the session has its own limit."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return (rows.mapInArrow if arrow else rows.mapInPandas)(_tidy(work), schema)


def with_ids(rows: DataFrame, key: str, work, out: str, columns: str) -> DataFrame:
    """``rows`` mapped by ``work`` in pandas batches to (out, columns), ``out`` holding the ids of ``key``.

    Whole-number ids travel as text, as pandas would turn a batch of them with a null into floats.
    """
    kind = rows.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return in_batches(rows, work, f"{out} {kind}, {columns}")
    rows = rows.withColumn(key, F.col(key).cast("string"))
    found = in_batches(rows, work, f"{out} string, {columns}")
    return found.withColumn(out, F.col(out).cast(kind))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], label: str, rank: str = "rank_") -> DataFrame:
    """``df`` with the row's place, from 0, in the whole order; stored once.

    Rows are dealt by ranges of the order, so no key gathers in one task: a row's place is its index
    within its range plus the rows of earlier ranges, one count per range. Rows equal in the whole order
    get consecutive places. The ranges are stored before they are counted, so a task that runs again
    reads the same ranges.
    """
    return placed(
        written(
            df.repartitionByRange(shuffle_width(df), *order)
            .sortWithinPartitions(*order)
            .withColumn("range_", F.spark_partition_id())
            .withColumn("index_", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))),
            label,
        ),
        rank,
    )


def placed(stored: DataFrame, rank: str) -> DataFrame:
    """Adds the rows of earlier ranges, at most one number per shuffle partition, to the index."""
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("range_")
        .agg(F.count("*").alias("rows_"))
        .select("range_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    )
    full = stored.join(F.broadcast(starts), "range_")
    full = full.withColumn(rank, F.col("start_") + F.col("index_")).drop("range_", "index_", "start_")
    full.stored_at = stored.stored_at
    return full
