"""Near copies of embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh–Hadamard transform; its hash is the signed axis nearest to
the rotated vector. ``FUNCTIONS`` hashes make a bucket, ``TABLES`` times; besides its own bucket a vector is put
into ``PROBES`` others per table, in which the hash with the smallest margin takes its runner-up. Vectors that
share a bucket are compared by cosine in double precision.

Equal vectors of a label are one node. Buckets are compared in blocks: a bucket above ``BLOCK`` nodes is cut into
hashed parts and each pair of parts is a cell, so no task needs a whole bucket. Cells put out one row per node,
its number of links and a link that keeps it connected, never pairs: a link is counted only in the cell of the
least bucket that its two nodes share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.llm.components import components
from splitlab.llm.frames import in_batches, pick, with_ids
from splitlab.llm.textblock import mixed
from splitlab.session import discard, written

TABLES, FUNCTIONS, PROBES, COSINE = 10, 3, 2, 0.98
BLOCK = 512
_PAIRS = 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh–Hadamard transform of each row, in place; the width is a power of 2."""
    n, width = x.shape
    step = 1
    while step < width:
        view = x.reshape(n, width // (2 * step), 2, step)
        low = view[:, :, 0] + view[:, :, 1]
        view[:, :, 1] = view[:, :, 0] - view[:, :, 1]
        view[:, :, 0] = low
        step *= 2
    return x


def codes(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Sorted bucket codes of unit vectors, rows × TABLES·(1 + PROBES); ``salt`` keeps labels apart."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    signs = np.random.default_rng(20240607 + width).choice([-1.0, 1.0], (TABLES, FUNCTIONS, 3, width))
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    rows = np.arange(n)
    out = []
    for t in range(TABLES):
        axis = np.empty((n, FUNCTIONS), np.int64)
        other, margin = axis.copy(), np.empty((n, FUNCTIONS))
        for f in range(FUNCTIONS):
            x = padded
            for turn in signs[t, f]:
                x = hadamard(x * turn) / np.sqrt(width)
            size = np.abs(x)
            best = size.argmax(1)
            top = size[rows, best]
            size[rows, best] = -1
            second = size.argmax(1)
            axis[:, f] = 2 * best + (x[rows, best] < 0)
            other[:, f] = 2 * second + (x[rows, second] < 0)
            margin[:, f] = top - size[rows, second]
        weakest = margin.argsort(1)
        for probe in range(PROBES + 1):
            chosen = axis.copy()
            if probe:
                at = weakest[:, probe - 1]
                chosen[rows, at] = other[rows, at]
            key = mixed(salt + np.uint64((t + 1) << 40))
            for f in range(FUNCTIONS):
                key = mixed(key + chosen[:, f].astype(np.uint64))
            out.append(key)
    return np.sort(np.stack(out, 1).view(np.int64), axis=1)


def _hashed(rows: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            nodes, vectors = [None] * len(batch), [None] * len(batch)
            keys: list = [None] * len(batch)
            by_width: dict[int, list[int]] = {}
            for i, (label, value) in enumerate(zip(batch["label"], batch["vector"], strict=True)):
                if label is None or value is None or not len(value):
                    continue
                v = np.asarray([np.nan if x is None else x for x in value], np.float64) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    continue
                vectors[i] = v.tobytes()
                nodes[i] = hashlib.blake2b(vectors[i] + label.encode(), digest_size=16).digest()
                by_width.setdefault(len(v), []).append(i)
            for width, at in by_width.items():
                x = np.stack([np.frombuffer(vectors[i]) for i in at])
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                salt = [hashlib.blake2b(f"{width}:{batch['label'].iloc[i]}".encode(), digest_size=8).digest() for i in at]
                found = codes(x / np.linalg.norm(x, axis=1, keepdims=True), np.frombuffer(b"".join(salt), np.uint64))
                for i, row in zip(at, found, strict=True):
                    keys[i] = row
            yield pd.DataFrame({"id": batch["id"], "node": nodes, "vector": vectors, "codes": keys})

    return with_ids(rows, "id", work, "id", "node binary, vector binary, codes array<long>")


def _cell(code: int, part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one cell: those between its two sides, or within its only one."""
    n = len(part)
    x = np.stack([np.frombuffer(v) for v in part["vector"]])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.stack(part["codes"].to_numpy())
    times, side = part["times"].to_numpy(), part["side"].to_numpy()
    low, high = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    if side.min() != side.max():
        across = side[low] != side[high]
        low, high = low[across], high[across]
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    for a in range(0, len(low), _PAIRS):
        i, j = low[a : a + _PAIRS], high[a : a + _PAIRS]
        shared = (keys[i][:, :, None] == keys[j][:, None, :]).any(2)
        first = keys[i, shared.argmax(1)] == code
        np.add.at(links, i[first], times[j[first]])
        np.add.at(links, j[first], times[i[first]])
    while True:  # least place reached within the cell
        before = root.copy()
        np.minimum.at(root, high, root[low])
        np.minimum.at(root, low, root[high])
        root = root[root]
        if (root == before).all():
            break
    touched = np.unique(np.concatenate([low, high]))
    nodes = part["node"].to_numpy()
    return pd.DataFrame({"node": nodes[touched], "links": links[touched], "root": nodes[root[touched]]})


def _links(cells: DataFrame, cosine: float) -> DataFrame:
    """Cells stand together and in order within a partition; one cell, at most two parts, is in memory."""

    def work(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            cell = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    yield _cell(batch["code"].iloc[a], batch.iloc[a:b], cosine)
            held = batch.iloc[cuts[-1] :] if len(cuts) else None
        if held is not None and len(held) > 1:
            yield _cell(held["code"].iloc[0], held, cosine)

    return in_batches(cells, work, "node binary, links long, root binary")


def link_embeddings(df: DataFrame, vec_id="vec_id", embedding="embedding", label="label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, have no
    links and are components of their own. Repeated rows are vectors of their own, linked with each other. Only
    vectors of one width are compared. An empty table gives no rows; other columns are left behind.
    """
    rows = pick(df, vec_id, embedding, label).toDF("id", "vector", "label")
    rows = rows.withColumn("label", F.col("label").cast("string"))
    hashed = written(_hashed(rows), "hashed")
    nodes = written(
        hashed.where("node IS NOT NULL").groupBy("node").agg(
            F.min("id").alias("rep"), F.count("*").alias("times"), F.first("vector").alias("vector"),
            F.first("codes").alias("codes"),
        ), "vectors",
    )
    spots = nodes.select("node", F.explode("codes").alias("code")).distinct()
    sizes = spots.groupBy("code").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    spots = spots.join(sizes, "code").withColumn("parts", parts)
    spots = spots.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = spots.select(
        "node", "code", F.col("part").alias("side"),
        F.xxhash64("code", F.least("part", "other"), F.greatest("part", "other")).alias("cell"),
    ).join(nodes.select("node", "times", "vector", "codes"), "node")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    found = written(_links(cells, cosine), "linked")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "rep", "times").join(counts, "node", "left")
    named = named.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(
        F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"
    )
    named = written(named, "named")
    out = hashed.select("id", "node").join(named, F.col("node") == F.col("of"), "left")
    discard(nodes, found)
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
