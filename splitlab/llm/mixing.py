"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document expects target / size of the source copies. Documents stand in the order
(size, hash of the id, id); the expected copies are summed along it, one random offset per source is added,
and a document is emitted once for each integer that the sum crosses at it. As sizes rise along the order,
the words taken differ from the target by at most a few times the largest document of the source.

Places in the order come from a range sort of all sources together, so a hot source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlab.llm.frames import numbered, ranked, word_count
from splitlab.session import discard, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, place, weight, target) of (source, source_size, docs).

    Sources in code point order, null last, take the weights in turn and split share × all sizes by them.
    A target stops at cap × its source's size; the excess goes to the others by weight until none is
    above. Each round of that is one aggregate of the stored table of sources; two numbers reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    table = ranked(sizes, order, "sources", "place")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = table
    table = written(table.withColumn("weight", choice), "weights")
    discard(held)
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    pool, capped, full = share * (total or 0), 0, 0
    most = F.col("source_size") * cap
    while True:
        left = (weight or 0) - capped
        level = (pool - full) / left if left > 0 else float("inf")
        over = most < F.col("weight") * F.lit(level)
        now_full, now_capped = table.where(over).agg(
            F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        ).first()
        if now_capped <= capped:
            break
        full, capped = now_full, now_capped
    level = F.lit(level)
    target = F.when(most < F.col("weight") * level, most.cast("double")).otherwise(F.col("weight") * level)
    out = table.withColumn("target", target)
    out.stored_at = table.stored_at
    return out


def copies(rate: Column, place: Column, offset: Column) -> Column:
    """Integers in (rate·place + offset, rate·(place + 1) + offset]; whole copies are taken off first."""
    whole = F.floor(rate)
    part = rate - whole
    crossed = F.floor(part * (place + 1) + offset) - F.floor(part * place + offset)
    return F.coalesce(whole + crossed, F.lit(0)).cast("long")


def mix(df: DataFrame, doc_id="doc_id", text="text", source="source", size: str | None = None, weights=WEIGHTS,
        share: float = 1.0, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every row of ``df`` with size_, source_size_, target_ and copies_ (times that the mix emits it).

    ``size`` names a column with the sizes; without it they are the word counts of ``text``.
    Null and empty texts have size 0: they count as documents of their source and get copies at its rate,
    0 if the whole source is empty. A null source is a source of its own. Repeated rows are documents of
    their own. Other columns are kept as they are, whatever their names. An empty table gives no rows.
    """
    frame, names = numbered(df)
    key, name = (f"c{names.index(x)}" for x in (doc_id, source))
    many = F.col(f"c{names.index(size)}") if size else word_count(F.col(f"c{names.index(text)}"))
    frame = frame.withColumns({"size_": many, "hash_": F.md5(F.col(key).cast("string"))})
    order = [F.col(name).asc_nulls_last(), F.col("size_"), F.col("hash_"), F.col(key)]
    rows = ranked(frame, order, "mix")
    sizes = rows.groupBy(F.col(name).alias("source")).agg(
        F.sum("size_").alias("source_size"), F.count("*").alias("docs"), F.min("rank_").alias("first")
    )
    table = source_targets(sizes, weights, share, cap)
    rows = rows.join(
        table.select(
            F.col("source").alias("source_"), F.col("source_size").alias("source_size_"),
            F.col("target").alias("target_"), "first",
        ),
        F.col(name).eqNullSafe(F.col("source_")),
    )
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(name), F.lit("\0"))))
    offset = F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / 4096
    rate = F.when(F.col("source_size_") > 0, F.col("target_") / F.col("source_size_"))
    taken = copies(rate, F.col("rank_") - F.col("first"), offset)
    out = rows.select(
        *[F.col(f"c{i}") for i in range(len(names))], "size_", "source_size_", "target_", taken.alias("copies_")
    )
    return out.toDF(*names, "size_", "source_size_", "target_", "copies_")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with the columns it came with."""
    frame, names = numbered(mixed)
    many = F.col(f"c{names.index('copies_')}")
    frame = frame.where(many > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), many)))
    keep = [(i, n) for i, n in enumerate(names) if n not in ("size_", "source_size_", "target_", "copies_")]
    return frame.select([F.col(f"c{i}") for i, _ in keep]).toDF(*[n for _, n in keep])


#: DuckDB SQL of op1: the same order, offsets and arithmetic; targets by the closed form of the resharing.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3.0 * source_size / weight AS ratio FROM s),
p AS (
  SELECT *,
    (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER w, 0) AS pool,
    (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT coalesce(sum(3 * source_size), 0) AS full_size, coalesce(sum(weight), 0) AS full_weight
  FROM p WHERE 3 * source_size < weight * (pool::DOUBLE / left_weight)),
l AS (
  SELECT (((SELECT sum(source_size) FROM s) - full_size)::DOUBLE
          / ((SELECT sum(weight) FROM s) - full_weight)::DOUBLE) AS level FROM c),
t AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size < weight * level THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target,
    ('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 3))::INTEGER::DOUBLE / 4096 AS u
  FROM s, l),
k AS (
  SELECT doc_id, size, source_size, target, u, target / source_size AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1 AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * (floor(rate)
    + floor((rate - floor(rate)) * (place + 1) + u) - floor((rate - floor(rate)) * place + u)) END::BIGINT AS taken
FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op1: sizes are counted before the sort, so texts are not moved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs, size="size").select(
        "doc_id", "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"),
        (F.col("copies_") * F.col("size")).alias("taken"),
    )
