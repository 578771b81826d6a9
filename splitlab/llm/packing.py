"""Sharding by best-fit decreasing: indivisible groups of equal texts go to the tightest shard that still holds them.

The packer itself sees a bounded number of items whatever the data: every group above 1 / (SHARE · shards) of all
bytes alone, at most SHARE · shards of them, and the other groups in hashed bundles, 2 · SHARE · shards of those.
Bundles keep groups whole. Free capacities stand in a balanced (AA) tree. For a fixed number of shards the
capacity is the least, by bisection, that the packing fits into. Everything else, sizes, groups and places, is
done by Spark on narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.llm.frames import numbered, ranked
from splitlab.session import discard, written

SHARDS, SHARE, OVERHEAD = 40, 500, 16


class _Node:
    __slots__ = ("key", "left", "right", "level")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class FreeSpace:
    """AA tree of (free capacity, bin): insert, remove, and the least entry of at least a size, in log time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(node):
        left = node.left
        if left is not None and left.level == node.level:
            node.left, left.right = left.right, node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node.right
        if right is not None and right.right is not None and right.right.level == node.level:
            node.right, right.left = right.left, node
            right.level += 1
            return right
        return node

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, node, key):
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._split(self._skew(node))

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None:
            return node.right
        elif node.right is None:
            return node.left
        else:
            next_up = node.right
            while next_up.left is not None:
                next_up = next_up.left
            node.key = next_up.key
            node.right = self._remove(node.right, next_up.key)
        lowest = 1 + min(c.level if c else 0 for c in (node.left, node.right))
        if lowest < node.level:
            node.level = lowest
            if node.right is not None and node.right.level > lowest:
                node.right.level = lowest
        node = self._skew(node)
        if node.right is not None:
            node.right = self._skew(node.right)
            if node.right.right is not None:
                node.right.right = self._skew(node.right.right)
        node = self._split(node)
        if node.right is not None:
            node.right = self._split(node.right)
        return node

    def tightest(self, size):
        """The least (free, bin) with free >= size, or None."""
        node, best = self.root, None
        while node is not None:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; ``sizes`` fall. Opens a bin when none holds the item, the lower bin wins equal space.

    An item above the capacity has a bin of its own. None if more than ``most`` bins are needed.
    """
    free, out, bins = FreeSpace(), [], 0
    for size in sizes:
        found = free.tightest(size)
        if found is None:
            if bins == most:
                return None
            found = (capacity, bins)
            bins += 1
        else:
            free.remove(found)
        left = found[0] - size
        if left >= 0:
            free.insert((left, found[1]))
        out.append(found[1])
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Best fit into ``shards`` bins with the least capacity that holds all.

    Items above the mean of what is left have bins of their own; the rest shares the other bins evenly.
    """
    rest, bins = sum(sizes), shards
    for size in sizes:
        if bins == 1 or size * bins <= rest:
            break
        rest, bins = rest - size, bins - 1
    low, high = max(-(-rest // bins), 1), max(sum(sizes), 1)
    best = best_fit(sizes, high, shards)
    step = max(low // 10_000, 1)
    # the capacity that fits lies little above the mean unless one item is larger: widen, then bisect
    top = low
    while top < high and (found := best_fit(sizes, top, shards)) is None:
        low, step = top + 1, 2 * step
        top = min(high, top + step)
    else:
        high, best = (top, found) if top < high else (high, best)
    while high - low > max(low // 20_000, 0):
        middle = (low + high) // 2
        found = best_fit(sizes, middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return best


def assign(docs: DataFrame, text="text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with size_ (UTF-8 bytes + 16), crc_ and shard_; equal texts share a shard.

    Null texts have no bytes and are equal to empty ones. Columns are kept as they are. An empty table gives no rows.
    """
    frame, names = numbered(docs)
    value = F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")).cast("binary")
    frame = frame.withColumns(
        {"size_": (F.octet_length(value) + OVERHEAD).cast("long"), "crc_": F.crc32(value), "group_": F.md5(value)}
    )
    return _assigned(frame, names, shards)


def _assigned(frame: DataFrame, names: list[str], shards: int) -> DataFrame:
    groups = written(frame.groupBy("group_").agg(F.sum("size_").alias("bytes_")), "groups")
    total = groups.agg(F.sum("bytes_")).first()[0] or 0
    large = F.col("bytes_") * (SHARE * shards) > total
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group_"), F.lit(2 * SHARE * shards)).cast("string"))
    groups = groups.withColumn("item_", F.when(large, F.col("group_")).otherwise(bundle))
    items = groups.groupBy("item_").agg(F.sum("bytes_").alias("bytes_")).collect()  # at most 3 · SHARE · shards
    items = sorted((-r["bytes_"], r["item_"]) for r in items)
    placed = pack([-size for size, _ in items], shards)
    spark = frame.sparkSession
    table = spark.createDataFrame(
        [(item, shard) for (_, item), shard in zip(items, placed, strict=True)], "item_ string, shard_ int"
    )
    where = written(groups.join(table, "item_").select(F.col("group_").alias("of_"), "shard_"), "shards")
    out = frame.join(where, F.col("group_") == F.col("of_")).drop("of_", "group_")
    discard(groups)
    return out.toDF(*names, "size_", "crc_", "shard_")


def slots(assigned: DataFrame, doc_id="doc_id") -> DataFrame:
    """Adds slot_, from 0 without gaps in each shard, in the order of doc_id, by one range sort of all rows."""
    frame, names = numbered(assigned)
    shard, key = (f"c{names.index(x)}" for x in ("shard_", doc_id))
    rows = ranked(frame, [F.col(shard), F.col(key).asc_nulls_first()], "slots")
    first = rows.groupBy(F.col(shard).alias("of_")).agg(F.min("rank_").alias("first_"))
    rows = rows.join(F.broadcast(first), F.col(shard) == F.col("of_"))  # one row per shard
    out = rows.select(*[f"c{i}" for i in range(len(names))], (F.col("rank_") - F.col("first_")).alias("slot_"))
    return out.toDF(*names, "slot_")


def query(spark, sf_dir: str) -> DataFrame:
    """op9 by the law ``bytes``. Texts are measured once; only narrow rows are stored and moved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    value = F.coalesce("text", F.lit("")).cast("binary")
    narrow = written(
        docs.select(
            F.col("doc_id").alias("c0"), (F.octet_length(value) + OVERHEAD).cast("long").alias("size_"),
            F.crc32(value).alias("crc_"), F.md5(value).alias("group_"),
        ), "sizes",
    )
    return slots(_assigned(narrow, ["doc_id"], SHARDS)).select(
        "doc_id", F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
