"""Joins against dimension-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.session import size_in_bytes


def measured_bytes(df: DataFrame) -> int:
    """Rows times column widths, with the true length of text columns."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + 8 + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        else:
            width = width + 16
    return df.agg(F.sum(width)).first()[0] or 0


def is_small(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether ``df`` measures no more than ``max_bytes``, by default the session's broadcast limit."""
    if max_bytes is None:
        max_bytes = size_in_bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return max_bytes > 0 and measured_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it measures below the session's limit.

    For tables Spark cannot size on its own (results of aggregations); file
    tables need no hint. Above the limit the join is left to the optimizer: a
    sort-merge join whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if is_small(df, max_bytes) else df


def attach(
    df: DataFrame, lookup: DataFrame, key: str, lookup_key: str | None = None, how: str = "left"
) -> DataFrame:
    """Join ``lookup`` on a differently named key; duplicate keys fan out."""
    lookup_key = lookup_key or key
    if lookup_key != key:
        lookup = lookup.withColumnRenamed(lookup_key, key)
    return df.join(lookup, key, how)
