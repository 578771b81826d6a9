"""Near copies by order MinHash on five-word shingles, verified by banded alignment.

A shingle's repeats in a text are told apart by number. Each of ``TABLES`` hash functions picks the ``PICKS``
least numbered shingles of a text and keeps them in text order; texts with an equal sketch in some table are
candidates. A pair is a link if its aligned similarity is at least ``SIMILARITY``: with M shingles matched in order
(longest common subsequence) out of n and m, M / (n + m - M). At 0.8 a pair shares no sketch with a chance of
about (1 - 0.8 ** PICKS) ** TABLES, 1 in 40,000.

Equal texts are one node. A bucket never meets in one task. First all its members are compared with its least one, in
joins on pairs, as many as members; the links found are joined to components. What may still be missing are links
between other members in different components. Such buckets are cut into hashed parts, and each pair of parts is a
cell, but for the largest component with itself. Cells compare all pairs of different components, first by an exact
bound on shared shingles, and put out only links that join components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.llm.components import components
from splitlab.llm.frames import in_batches, pick, with_ids
from splitlab.llm.textblock import TextBlock, blocks, mixed, windows
from splitlab.session import discard, written

WORDS, PICKS, TABLES, SIMILARITY = 5, 3, 16, 0.8
#: Candidate ids are broadcast up to this number (24 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_ODD = np.random.default_rng(7).integers(1, 1 << 62, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK_ROWS = 2048
#: Texts in a part of a bucket, and counters of the bound on shared shingles.
PART, COUNTERS = 256, 128


def shingles(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle in text order; a text of fewer words has one, of all its words."""
    words, doc = block.word_hashes(), block.word_doc
    first, value = windows(words, doc, WORDS)
    sizes = block.words_of()
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(sizes)])[short]
        extra = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            more = k < sizes[short]
            extra[more] = mixed(extra[more] + words[starts[more] + k])
        owner = np.concatenate([doc[first], short])
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate([value, extra])[order]
    return doc[first], value


def sketches(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, texts × tables sketches); texts without a word have sketches that are not used."""
    sizes = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, TABLES), np.uint64)
    if not len(doc):
        return sizes, out
    # number the repeats of a shingle within its text
    own = mixed(value + mixed(doc.astype(np.uint64) + np.uint64(11)))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    repeat = np.empty(len(order), np.uint64)
    repeat[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    labelled = mixed(value + repeat * np.uint64(0x9E3779B97F4A7C15))
    held = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[held]
    place = np.repeat(np.arange(len(held)), sizes[held])
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(TABLES):
        rank = mixed_once(labelled, _ODD[t])
        picked = []
        for _ in range(PICKS):
            low = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero(rank == low[place])
            first = at[np.unique(place[at], return_index=True)[1]]
            picked.append(np.where(low == most, len(value), first))
            rank[first] = most
        rows = np.sort(np.stack(picked, 1), axis=1)
        full = np.append(value, np.uint64(0))
        key = np.full(len(held), t + 1, np.uint64)
        for k in range(PICKS):
            key = mixed(key + full[rows[:, k]])
        out[held, t] = key
    return sizes, out


def mixed_once(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = x * odd
    return x ^ (x >> np.uint64(31))


def aligned(a: np.ndarray, b: np.ndarray, slack: int) -> int:
    """Elements matched in order, in a band of ``slack`` places around the diagonal, by bit-parallel rows.

    Exact if at most ``slack`` elements of both stay unmatched; never above the true number.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    free = (1 << len(a)) - 1
    step = max(_BLOCK_ROWS, slack)
    for row in range(0, len(b), step):
        low, high = max(0, row - slack), min(len(a), row + step + slack)
        if low >= high:
            break
        places: dict[int, int] = {}
        for i in range(low, high):
            places[a[i]] = places.get(a[i], 0) | 1 << (i - low)
        full = (1 << (high - low)) - 1
        window = free >> low & full
        for value in b[row : row + step]:
            hit = window & places.get(value, 0)
            if hit:
                window = ((window + hit) | (window - hit)) & full
        free ^= ((free >> low & full) ^ window) << low
    return head + tail + len(a) - free.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned similarity; 0 where it is below ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    slack = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    if abs(n - m) > slack or n + m - 2 * _common(a, b) > slack:
        return 0.0
    matched = aligned(a, b, slack)
    value = matched / (n + m - matched)
    return value if value >= least else 0.0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements, repeats counted: no alignment matches more."""
    values, sides = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(sides[: len(a)], minlength=len(values))
    right = np.bincount(sides[len(a) :], minlength=len(values))
    return int(np.minimum(left, right).sum())


def _sketch(rows: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            texts = list(batch["text"])
            for a, b in blocks(texts):
                block = TextBlock(texts[a:b])
                sizes, keys = sketches(*shingles(block), block.docs)
                yield pd.DataFrame(
                    {
                        "id": batch["id"].to_numpy()[a:b],
                        "node": batch["node"].to_numpy()[a:b],
                        "n": sizes.astype("int32"),
                        "keys": list(keys.view(np.int64)),
                    }
                )

    return with_ids(rows, "id", work, "id", "node binary, n int, keys array<long>")


def _contents(rows: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            texts = list(batch["text"])
            for a, b in blocks(texts):
                block = TextBlock(texts[a:b])
                doc, value = shingles(block)
                cuts = np.searchsorted(doc, np.arange(block.docs + 1))
                small = (value >> np.uint64(32)).astype(np.uint32)
                yield pd.DataFrame(
                    {
                        "node": batch["node"].to_numpy()[a:b],
                        "shingles": [small[cuts[i] : cuts[i + 1]].tobytes() for i in range(block.docs)],
                    }
                )

    return in_batches(rows, work, "node binary, shingles binary")


def _verify(pairs: DataFrame, contents: DataFrame, least: float) -> DataFrame:
    """(a, b, linked) of (a, b)."""

    def work(batches):
        for batch in batches:
            linked = [
                similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least
                for x, y in zip(batch["left"], batch["right"], strict=True)
            ]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    full = pairs.join(contents.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    full = full.join(contents.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return in_batches(full.select("a", "b", "left", "right"), work, "a binary, b binary, linked boolean")


def near_classes(docs: DataFrame, doc_id="doc_id", text="text", least: float = SIMILARITY) -> DataFrame:
    """(id, node, class_id) of every row: the least id of its class of equal and linked texts.

    Null texts count as empty; empty texts equal each other and nothing else. Repeated rows are copies. Ties cannot
    occur, as classes are named by their least id. A null id is a row like others, but names no class unless it is
    alone. An empty table gives no rows; other columns are left behind.
    """
    return _classes(docs, doc_id, text, least).drop("head")


def _classes(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """``near_classes`` and the node of the one row that stands for the class: least id, nulls last, then least node."""
    rows = pick(docs, doc_id, text).toDF("id", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    sketch = written(_sketch(rows), "sketch")
    nodes = written(
        sketch.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes"
    )
    banded = nodes.where("n > 0").select(F.explode("keys").alias("key"), "node", "n").distinct()
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min_by(F.struct("node", "n"), "node").alias("pivot"))
    members = written(banded.join(shared.where("size > 1"), "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    many = wanted.count()
    wanted = wanted.select(F.col("node").alias("want"), "rep")
    found = rows.join(
        F.broadcast(wanted) if many <= BROADCAST_IDS else wanted,
        (F.col("node") == F.col("want")) & F.col("id").eqNullSafe(F.col("rep")),
    )
    contents = written(_contents(found.select("node", "text")).dropDuplicates(["node"]), "contents")
    links, roots = _link(members, contents, least)
    named = nodes.select("node", "rep").join(roots.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(
        F.min("rep").alias("class_id"), F.min_by("node", F.struct(F.isnull("rep"), "rep", "node")).alias("head")
    )
    named = written(named.join(least_id, "root").select("node", "class_id", "head"), "classes")
    discard(nodes, members, contents, *links)
    out = sketch.select("id", "node").join(named, "node")
    return out


def _link(members: DataFrame, contents: DataFrame, least: float) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables to discard, and (id, root) of the linked nodes that are not roots."""
    rest = members.where(F.col("node") != F.col("pivot.node"))
    near = F.least(F.col("n"), F.col("pivot.n")) >= least * F.greatest(F.col("n"), F.col("pivot.n"))
    pairs = rest.where(near).select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
    first = written(_verify(pairs, contents, least).where("linked").select("a", "b"), "links")
    roots = components(first, "near")
    state = rest.where("size > 2").select("key", "node").join(roots.withColumnRenamed("id", "node"), "node", "left")
    state = written(state.withColumn("root", F.coalesce("root", "node")), "state")
    kinds = state.groupBy("key", "root").agg(F.count("*").alias("many"))
    kinds = kinds.groupBy("key").agg(
        F.count("*").alias("kinds"), F.sum("many").alias("all"), F.max("many").alias("most"),
        F.max_by("root", F.struct("many", "root")).alias("main"),
    ).where("kinds > 1")
    small = F.ceil((F.col("all") - F.col("most")) / PART).cast("int")  # parts of the other components
    large = F.ceil(F.col("most") / PART).cast("int")
    spots = state.join(kinds, "key").withColumns({"small": small, "large": large})
    spread, is_main = F.xxhash64("node"), F.col("root") == F.col("main")
    spots = spots.withColumn(
        "part",
        F.when(is_main, F.col("small") + F.pmod(spread, F.col("large"))).otherwise(F.pmod(spread, F.col("small"))).cast("int"),
    )
    last = F.when(is_main, F.col("small")).otherwise(F.col("small") + F.col("large")) - 1
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    cells = spots.select(cell.alias("cell"), F.col("part").alias("side"), "node", "root").join(contents, "node")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    second = written(_cells(cells, least), "links")
    every = second.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
    final = components(every, "near")
    return [first, roots, state, second, final], final


def _cells(cells: DataFrame, least: float) -> DataFrame:
    """Links of cells that stand together within a partition; one cell, at most two parts, is in memory."""

    def work(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            cell = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    yield _cell(batch.iloc[a:b], least)
            held = batch.iloc[cuts[-1] :] if len(cuts) else None
        if held is not None and len(held) > 1:
            yield _cell(held, least)

    return in_batches(cells, work, "a binary, b binary")


def _cell(part: pd.DataFrame, least: float) -> pd.DataFrame:
    nodes, side = part["node"].tolist(), part["side"].to_numpy()
    texts = [np.frombuffer(x, np.uint32) for x in part["shingles"]]
    sizes = np.array([len(t) for t in texts])
    counts = np.stack([np.bincount(t % np.uint32(COUNTERS), minlength=COUNTERS) for t in texts]).astype(np.int32)
    group = pd.factorize(part["root"])[0]
    one_side = side.min() == side.max()
    up = list(range(len(nodes)))  # components, joined as links are found
    for root in range(group.max() + 1):
        at = np.flatnonzero(group == root)
        for i in at[1:]:
            up[i] = int(at[0])

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    found = []
    for i in range(len(nodes)):
        others = np.flatnonzero((group != group[i]) & ((np.arange(len(nodes)) > i) if one_side else (side > side[i])))
        if not len(others):
            continue
        slack = ((sizes[i] + sizes[others]) * (1 - least) / (1 + least) + 1e-9).astype(np.int64)
        apart = np.abs(counts[others] - counts[i]).sum(1)  # at least so many shingles stay unmatched
        for j in others[apart <= slack].tolist():
            a, b = top(i), top(j)
            if a != b and similarity(texts[i], texts[j], least) >= least:
                up[max(a, b)] = min(a, b)
                found.append((nodes[i], nodes[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs).select(
        F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, doc_id="doc_id", text="text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, the one with the least id; columns as they are.

    Ids need not tell classes apart: texts of null ids or of one id stay if their classes differ.
    """
    classes = _classes(docs, doc_id, text, least)
    chosen = classes.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("head")))
    chosen = chosen.groupBy("id", "node").agg(F.count("*").alias("times"))
    chosen = written(chosen, "chosen")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, words = (f"c{docs.columns.index(x)}" for x in (doc_id, text))
    node = F.unhex(F.md5(F.coalesce(F.col(words), F.lit("")).cast("binary")))
    out = plain.withColumn("node_", node).join(
        chosen, F.col(key).eqNullSafe(F.col("id")) & (F.col("node_") == F.col("node")), "left_semi"
    )
    if not chosen.where("times > 1").isEmpty():  # of rows with one id and text the least in all columns
        out = out.groupBy(key, "node_").agg(F.min(F.struct(*plain.columns)).alias("row_")).select("row_.*", "node_")
    return out.drop("node_").toDF(*docs.columns)
