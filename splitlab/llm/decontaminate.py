"""Benchmark decontamination by a broadcast hash set of test n-grams, with DataFrame functions only.

Texts are lower-cased (A to Z) and cut into words. A benchmark item gives its windows of ``SIZE`` consecutive words; an
item of fewer words is one window. The distinct windows, with their 64-bit keys, are the hash set. Documents
are scanned once: every window of each length that the set holds is looked up by key, in the task that reads the text,
and a hit is verified word by word. Windows that are not in the set never leave their task.

The set's size is measured before it is broadcast. Beyond ``SET_BYTES`` it is cut by key into blocks that fit, and the
documents, numbered and stored once, are scanned once for each block. Results are the same.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlab.llm.frames import numbered, pick
from splitlab.session import written

SIZE = 10
#: Bytes of the broadcast hash set, at most; a window takes its text and about 64 bytes more.
SET_BYTES = 64 << 20
#: Digits, letters and all that is not ASCII; a positive class, which Java matches eight times as fast as the negated one.
_IN = r"0-9A-Za-z\x80-\x{10FFFF}"
WORDS, APART = f"[{_IN}]+", f"[^{_IN}]*"


def words_of(text: Column) -> Column:
    """The words in small letters; none for null."""
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(small, F.lit(WORDS), F.lit(0))


def _coded(rows: DataFrame, words: str, size: int) -> DataFrame:
    """Adds d1_, d2_, d4_, …: the keys of the runs of so many words that begin at each word, halves joined."""
    rows = rows.withColumn("d1_", F.transform(words, lambda w: F.xxhash64(w)))
    step = 1
    while 2 * step <= size:
        rows = rows.withColumn(f"d{2 * step}_", _joined(F.col(f"d{step}_"), f"d{step}_", step))
        step *= 2
    return rows


def _joined(keys: Column, more: str, ahead: int) -> Column:
    rest = F.slice(more, F.lit(ahead + 1), F.greatest(F.size(more) - ahead, F.lit(0)))
    return F.zip_with(keys, rest, lambda a, b: F.xxhash64(a, b))


def _window_keys(ends: Column, size: int) -> Column:
    """Keys of the windows of ``size`` words at the first ``ends`` places, from the columns of ``_coded``."""
    step = 1 << (size.bit_length() - 1)
    keys, ahead = F.col(f"d{step}_"), step
    while ahead < size:
        step = 1 << ((size - ahead).bit_length() - 1)
        keys = _joined(keys, f"d{step}_", ahead)
        ahead += step
    return F.slice(keys, F.lit(1), F.greatest(ends, F.lit(0)))


def test_windows(items: DataFrame, item_id="item_id", text="text", size: int = SIZE) -> DataFrame:
    """(item, window, length, key) of every window of every item; items without a word have none.

    Item ids are taken as strings; a null id counts as the item ''. Repeated rows repeat their windows.
    """
    rows = pick(items, item_id, text).toDF("item", "text")
    rows = rows.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(size)))
    rows = _coded(rows, "words", size)
    ends = F.size("words") - F.col("length") + 1
    keys = F.lit(None).cast("array<bigint>")
    for n in range(1, size + 1):
        keys = F.when(F.col("length") == n, _window_keys(ends, n)).otherwise(keys)
    rows = rows.select("item", "words", "length", F.posexplode(keys).alias("at", "key"))
    return rows.select("item", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"), "length", "key")


def _looked_up(rows: DataFrame, names: list[str], block: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """Hits of one block of the set in ``rows``; with ``first`` also a row for each row itself, its place_ 0."""
    keys, start, width = [F.array(F.lit(None).cast("long"))], F.lit(1), F.lit(None).cast("int")
    at = F.lit(0)
    for n in lengths:
        ends = F.size("words_") - n + 1
        keys.append(_window_keys(ends, n))
        inside = F.col("nth_") >= start
        width = F.when(inside, F.lit(n)).otherwise(width)
        at = F.when(inside, F.col("nth_") - start).otherwise(at)
        start = start + F.greatest(ends, F.lit(0))
    rows = _coded(rows, "words_", max(lengths, default=1))
    rows = rows.select("row_", *names, "words_", F.posexplode(F.concat(*keys)).alias("nth_", "key_"))
    rows = rows.withColumn("at_", F.when(F.col("nth_") > 0, at)).withColumn("width_", width)
    rows = rows.join(F.broadcast(block), F.col("key_") == F.col("key"), "left" if first else "inner")
    head = F.col("nth_") == 0
    # verified here and not in the join, where it would be a key that every window has to be spelled for
    same = F.array_join(F.slice("words_", F.col("at_") + 1, F.col("width_")), " ") == F.col("window")
    rows = rows.where(head | (F.col("window_").isNotNull() & same))
    return rows.select(
        "row_", *[F.when(head, F.col(c)).alias(c) for c in names], F.when(head, F.size("words_")).alias("n_words_"),
        "at_", "width_", "window_",
    )


def _runs(hits: DataFrame) -> DataFrame:
    """(of_, n_hit_, spans_) of each row with hits: its windows joined where they touch, in one pass along the words."""
    along = Window.partitionBy("row_").orderBy("at_")
    hits = hits.groupBy("row_", "at_").agg((F.col("at_") + F.max("width_")).alias("end_"))
    reach = F.max("end_").over(along.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new_", F.coalesce((F.col("at_") > reach).cast("int"), F.lit(1)))
    hits = hits.withColumn("run_", F.sum("new_").over(along))
    runs = hits.groupBy("row_", "run_").agg(F.min("at_").alias("at"), F.max("end_").alias("end"))
    return runs.groupBy(F.col("row_").alias("of_")).agg(
        F.sum(F.col("end") - F.col("at")).cast("long").alias("n_hit_"),
        F.sort_array(F.collect_list(F.struct("at", "end"))).alias("spans_"),
    )


def mark(docs: DataFrame, items: DataFrame, text="text", item_id="item_id", item_text="text", size: int = SIZE,
         set_bytes: int = SET_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with n_words_, n_hit_, spans_ and items_.

    spans_ are the runs of words, from 0 and the end exclusive, that occurrences of test windows cover; n_hit_ counts
    their words; items_ are the sorted ids, as strings, of the items with a window in the text. A null text has no
    word. Null and empty texts hit nothing; a repeated row is marked by itself; items with equal windows are all
    named. Without documents there are no rows, and without items nothing is hit. Columns of ``docs`` are kept as
    they are, whatever their names; ``keep`` names the only ones that are wanted.
    """
    frame, names = numbered(docs)
    words = words_of(F.col(f"c{names.index(text)}"))
    held = written(test_windows(items, item_id, item_text, size), "test-windows")
    unique = held.groupBy("window", "length", "key").agg(F.count("*").alias("times"))
    unique = written(unique.withColumn("window_", F.monotonically_increasing_id()).drop("times"), "test-set")
    lengths = sorted(r.length for r in unique.select("length").distinct().collect())  # at most ``size``
    room = unique.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    blocks = max(1, -(-room // set_bytes))
    rows = frame.withColumn("row_", F.monotonically_increasing_id())
    if blocks > 1:
        rows = written(rows, "numbered")
    rows = rows.withColumn("words_", words)
    columns = [f"c{names.index(n)}" for n in keep] if keep is not None else frame.columns
    names = keep if keep is not None else names
    base = None
    for block in range(blocks):
        own = unique.where(F.pmod(F.col("key"), F.lit(blocks)) == block).select("key", "window", "window_")
        found = _looked_up(rows, columns, own, lengths, block == 0)
        if block == 0:  # numbers rows and keeps them with their hits, so that a lost task can't renumber them
            base = written(found, "scan")
            hits = base.where(F.col("window_").isNotNull())
        else:
            hits = hits.unionByName(written(found.where(F.col("window_").isNotNull()), "scan").select(hits.columns))
    named = held.select("window", "item").distinct().join(unique.select("window", "window_"), "window").select("window_", "item")
    named = hits.select("row_", "window_").distinct().join(named, "window_").groupBy("row_")
    named = named.agg(F.sort_array(F.collect_set("item")).alias("items_")).withColumnRenamed("row_", "in_")
    out = base.where(F.col("window_").isNull()).drop("at_", "width_", "window_")
    out = out.join(_runs(hits), F.col("row_") == F.col("of_"), "left").join(named, F.col("row_") == F.col("in_"), "left")
    out = out.select(
        *columns, F.col("n_words_").cast("long"), F.coalesce(F.col("n_hit_"), F.lit(0).cast("long")),
        F.coalesce(F.col("spans_"), F.array().cast("array<struct<at:int,end:int>>")),
        F.coalesce(F.col("items_"), F.array().cast("array<string>")),
    )
    return out.toDF(*names, "n_words_", "n_hit_", "spans_", "items_")


def clean_documents(marked: DataFrame) -> DataFrame:
    """The rows of ``mark`` that hit nothing, with the columns they came with."""
    frame, names = numbered(marked)
    frame = frame.where(F.col(f"c{names.index('n_hit_')}") == 0)
    return frame.select(frame.columns[:-4]).toDF(*names[:-4])


def without_spans(marked: DataFrame, text="text") -> DataFrame:
    """All rows of ``mark``; covered words, with what stands between and behind them, are cut out of their texts.

    Rows without a hit keep their text byte for byte.
    """
    frame, names = numbered(marked)
    body, spans = F.col(f"c{names.index(text)}"), F.col(f"c{len(names) - 2}")
    parts = F.regexp_extract_all(body, F.lit(WORDS + APART), F.lit(0))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["at"]), F.array(F.size(parts)))
    frame = frame.withColumn("parts_", parts).withColumn("gaps_", F.arrays_zip(ends.alias("from"), starts.alias("to")))
    kept = F.flatten(F.transform("gaps_", lambda g: F.slice("parts_", g["from"] + 1, g["to"] - g["from"])))
    cut = F.concat(F.regexp_extract(body, "^" + APART, 0), F.array_join(kept, ""))
    frame = frame.withColumn(f"c{names.index(text)}", F.when(F.size(spans) > 0, cut).otherwise(body))
    return frame.select(frame.columns[: len(names) - 4]).toDF(*names[:-4])


#: DuckDB SQL of op12: windows of every length that items have, joined as text.
SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT r, i, x.k, item_id FROM x JOIN g ON x.gram = g.gram),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
m AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op12: digests of the marks of every document."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return marked.select(
        "doc_id", F.col("n_words_").alias("n_words"), F.col("n_hit_").alias("n_hit"),
        F.size("items_").cast("long").alias("n_items"), F.sha2(F.array_join("items_", ","), 256).alias("items_sha256"),
        (F.col("n_hit_") > 0).alias("contaminated"),
    )
