"""Position of a row within its group, without gathering a group in one task."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_present(keys) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def position_marks(df: DataFrame, keys, order, positions) -> DataFrame:
    """Per group, the order key found at each of a few small 0-based positions.

    The bound on the row number reaches below the shuffle as a group limit, so
    each task sends on at most ``max(positions) + 1`` rows of a group however
    large the group is. Columns: keys, ``at_<position>`` (NULL past the end).
    """
    depth = max(positions) + 1
    # the hash leads the sort: most comparisons end at its eight bytes
    group = ["_group", *keys]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ranked = (
        df.select(F.xxhash64(*keys).alias("_group"), *keys, *order)
        .filter(all_present(keys))
        .withColumn("_nth", nth)
        .filter(F.col("_nth") <= depth)
    )
    # grouped by the keys alone, so that an unread join to the marks can be pruned
    return ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_nth") == p + 1, F.struct(*order))).alias(f"at_{p}")
            for p in positions
        ]
    )


def _edges(df: DataFrame, lead: str, side: int) -> tuple[list, list]:
    """Quantile edges of ``lead``, about one per shuffle partition, in two levels.

    ``outer`` parts the column in ``side`` stretches, ``inner[i]`` stretch i again.
    """
    n = side * side
    fractions = [i / n for i in range(1, n)]
    flat = df.agg(F.percentile_approx(lead, fractions, 20 * n)).first()[0]
    if not flat:
        return [], [[]]
    outer = [flat[i * side - 1] for i in range(1, side)]
    inner = [flat[i * side : i * side + side - 1] for i in range(side)]
    return outer, inner


def _stretch(lead: Column, outer: list, inner: list) -> Column:
    """Number of the stretch a value falls in; values keep their order."""
    if not outer:
        return F.lit(0)
    major = F.size(F.filter(F.lit(outer), lambda e: e < lead))
    minor = F.size(F.filter(F.get(F.lit(inner), major), lambda e: e < lead))
    return major * len(inner) + minor


def ordinal_in_group(
    df: DataFrame, keys, order, name: str, chunks: int | None = None
) -> DataFrame:
    """0-based running number of each row in its group, in ``order``.

    Rows are cut into stretches of the leading order column at approximate
    quantiles; rows are numbered within (group, stretch) and lifted by the
    group's counts in earlier stretches. One huge group thus spreads over all
    stretches, and any edges give the same numbers. Rows with a missing key take
    no part and get NULL. The leading order column should be close to unique.
    """
    if chunks is None:
        chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(2, ceil(sqrt(chunks)))
    numberless = df.filter(~all_present(keys)).withColumn(name, F.lit(None).cast("long"))
    df = df.filter(all_present(keys))
    cut = df.withColumn("_stretch", _stretch(F.col(order[0]), *_edges(df, order[0], side)))

    group = [*keys, "_stretch"]
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lifts = (
        cut.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lift"))
    )
    within = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return (
        cut.withColumn("_within", within)
        .join(lifts, group, "left")
        .withColumn(name, F.col("_within") + F.col("_lift"))
        .select(*df.columns, name)
        .union(numberless.select(*df.columns, name))
    )
