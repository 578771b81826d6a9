"""Cross-tokenizer alignment with an identity-map fast path.

Every text is encoded by a byte-level BPE (A) and a sentencepiece model (B). Places where tokens of both end cut the
bytes into groups; two tokens are linked where their bytes overlap, so the stretches between neighbouring ends of either
kind are the links. A group of one token each whose B id is the one that A's id has in the identity map (same bytes)
is regular. Regular groups are counted in a vector as long as A's vocabulary; only links of the other groups go, added up
by task, to the shuffle that counts pairs.

Texts are encoded once: ids are stored packed, and two more passes over them count pairs and look the counts up. For that
the identity vectors are broadcast (their size is the vocabulary's). So is the table of the other pairs if its measured size
is at most ``TABLE_PAIRS`` rows; beyond it the irregular links of each document are joined to it by Spark.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.llm import rans
from splitlab.llm.frames import in_batches, pick
from splitlab.session import discard, written

#: Chunks of text that a worker remembers for each tokenizer, and rows of the broadcast table of pairs (17 bytes each).
MAX_CHUNKS, TABLE_PAIRS = 400_000, 4_000_000
#: Bytes of text whose tokens are aligned in one go, and links that a task adds up before it hands them on.
BLOCK_BYTES, HELD_LINKS = 1 << 20, 2_000_000
_SPACE = "▁"


class _First(rans.Encoder):
    """Tokenizer A. Strings of added tokens are plain text."""

    def encode(self, text: str) -> bytes:
        return self._plain(text)


class _Second:
    """Tokenizer B with a memo of what stands between spaces.

    Where no piece holds a space behind another character, texts may be cut before any single space that something solid
    follows. Other texts, and those that spell the model's space sign, are encoded whole.
    """

    def __init__(self, path: str, limit: int = MAX_CHUNKS):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        self.spelled = [
            bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.cut = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.chunks, self.older, self.limit = {}, {}, limit // 2

    def learn(self, texts: list[str]) -> None:
        """Encodes the chunks of the texts that the memo lacks, in one call."""
        if not self.cut:
            return
        if len(self.chunks) >= self.limit:
            self.chunks, self.older = {}, self.chunks
        seen = set().union(*(t.split(" ") for t in texts)) - self.chunks.keys()
        fresh = []
        for chunk in seen:
            if chunk in self.older:
                self.chunks[chunk] = self.older[chunk]
            else:
                fresh.append(chunk)
        for chunk, ids in zip(fresh, self.tool.encode(fresh, num_threads=1), strict=True):
            right = b"".join([self.spelled[i] for i in ids]) == b" " + chunk.encode()
            self.chunks[chunk] = array("I", ids).tobytes() if right and chunk and _SPACE not in chunk else None

    def encode(self, text: str) -> bytes | None:
        """Ids of a text whose chunks are known; None if they do not spell a space and the text."""
        if self.cut:
            parts = list(map(self.chunks.get, text.split(" ")))
            if None not in parts:
                return b"".join(parts)
        ids = self.tool.encode(text, num_threads=1)
        if b"".join([self.spelled[i] for i in ids]) != b" " + text.encode():
            return None
        return array("I", ids).tobytes()


def byte_spelling(path: str) -> dict[int, bytes]:
    """id → bytes of a byte-level vocabulary: printable bytes stand for themselves, the others for 256, 257, …"""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in shown}
    value |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return {i: bytes(value[c] if c in value else 0 for c in token) if all(c in value for c in token) else token.encode()
            for token, i in vocabulary.items()}


class Pairing:
    """Both tokenizers, byte lengths of their ids and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = _First(path_a, limit=MAX_CHUNKS), _Second(path_b)
        self.spelled = byte_spelling(path_a)
        self.size_a = np.zeros(max(self.spelled) + 1, np.int64)
        for i, token in self.spelled.items():
            self.size_a[i] = len(token)
        self.size_b = np.array([len(t) for t in self.second.spelled], np.int64)
        whole = {t: i for i, t in reversed([*enumerate(self.second.spelled)]) if not self.second.tool.is_byte(i)}
        single = {t: i for i, t in enumerate(self.second.spelled) if self.second.tool.is_byte(i)}
        same = single | whole
        self.same = np.full(len(self.size_a), -1, np.int64)
        for i, token in self.spelled.items():
            self.same[i] = same.get(token, -1)
        have = set(self.spelled.values())
        self.lossless = all(bytes([b]) in have for b in range(256))

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids of a space and the text, as 32-bit numbers; nothing where one of them does not spell it."""
        if not text:
            return b"", b""
        b = self.second.encode(text)
        if b is None:
            return b"", b""
        a = self.first.encode(" " + text)
        if not self.lossless and b"".join(self.spelled[i] for i in array("I", a)) != b" " + text.encode():
            return b"", b""
        return a, b


@lru_cache(maxsize=2)
def pairing(path_a: str, path_b: str) -> Pairing:
    return Pairing(path_a, path_b)


def _paths(path_a, path_b):
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """The stored ids (row_, doc_id, a, b) of every whole text, packed as little-endian 32-bit numbers.

    Null and empty texts have none, nor have texts that one of the tokenizers does not spell back. A repeated row, and rows of
    a null id, stand for themselves (row_ tells them apart). An empty table gives no rows; other columns are left behind.
    """
    paths = _paths(path_a, path_b)
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").withColumn("row_", F.monotonically_increasing_id())

    def work(batches):
        tool = pairing(*paths)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # few texts at a time, as ids take more room than they do
                part = batch.slice(low, 256)
                texts = part.column(2).to_pylist()
                tool.second.learn([t for t in texts if t])
                a, b = zip(*map(tool.encode, texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                    names=["row_", "doc_id", "a", "b"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = in_batches(rows.select("row_", "doc_id", "text"), work, f"row_ long, doc_id {kind}, a binary, b binary", arrow=True)
    return written(found, "token-pairs", compression="zstd")


class Block:
    """The links and groups of some documents, whose tokens stand one after the other."""

    def __init__(self, tool: Pairing, a: list[bytes], b: list[bytes]):
        self.a, self.b = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in xs], np.int64) for xs in (a, b))
        ends_a, ends_b = np.cumsum(tool.size_a[self.a]), np.cumsum(tool.size_b[self.b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        of_a, of_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        of_a[ends_a] = True
        of_b[ends_b] = True
        place = np.flatnonzero(of_a | of_b)
        self.end_a, self.end_b = of_a[place], of_b[place]
        closed = self.end_a & self.end_b  # a link that ends a group
        self.link_a = self.a[np.cumsum(self.end_a) - self.end_a]
        self.link_b = self.b[np.cumsum(self.end_b) - self.end_b]
        self.group = np.cumsum(closed) - closed
        last = np.flatnonzero(closed)
        self.alone = np.diff(last, prepend=-1) == 1
        self.regular = self.alone[self.group] & (tool.same[self.link_a] == self.link_b)
        # documents end where groups end; those without tokens end where the one before them does
        docs = np.concatenate([[0], np.cumsum(tool.size_a[self.a])])[np.cumsum(self.n_a)]
        self.links_to = np.searchsorted(place, docs, "right")
        self.n_links = np.diff(self.links_to, prepend=0)
        self.groups_to = np.concatenate([[0], np.cumsum(closed)])[self.links_to]
        self.n_groups = np.diff(self.groups_to, prepend=0)

    def per_doc(self, of_links: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_links)])[self.links_to], prepend=0)

    def spelled(self, names: list[str]):
        """``a1,a2|b1;a3|b2,b3`` of each document; ``names`` has each id with a comma, a bar and a semicolon."""
        group_a, group_b = self.group[self.end_a], self.group[self.end_b]
        many = len(self.alone)
        in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        start = np.cumsum(in_a + in_b) - in_a - in_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        at = start[group_a] + np.arange(len(self.a)) - (np.cumsum(in_a) - in_a)[group_a]
        out[at] = 3 * self.a + np.append(group_a[1:] != group_a[:-1], [True] * (len(self.a) > 0))
        at = (start + in_a)[group_b] + np.arange(len(self.b)) - (np.cumsum(in_b) - in_b)[group_b]
        out[at] = 3 * self.b + 2 * np.append(group_b[1:] != group_b[:-1], [True] * (len(self.b) > 0))
        ends = np.cumsum(self.n_a + self.n_b)
        for low, high in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True):
            yield "".join(map(names.__getitem__, out[low:high].tolist()))[:-1]


def _blocks(batches, tool: Pairing):
    """(batch's slice, block) with about BLOCK_BYTES of text each; a longer text is a block of its own."""
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in "ab")
        low = 0
        while low < len(a):
            high, held = low, 0
            while high < len(a) and (high == low or held + len(a[high]) <= BLOCK_BYTES):
                held += len(a[high])  # four bytes an id, about what its text takes
                high += 1
            yield batch.slice(low, high - low), Block(tool, a[low:high], b[low:high])
            low = high


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pair_counts(stored: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The stored (a, b, n, best) of all pairs of ids with a link, n links in all; best: no other a has more with b."""
    paths = _paths(path_a, path_b)

    def work(batches):
        tool = pairing(*paths)
        vector = np.zeros(len(tool.size_a), np.int64)
        held, room = [], 0

        def rows(a, b, n):
            for at in range(0, len(a), 1 << 18):
                cut = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(n[cut])], names=["a", "b", "n"])

        def emptied():
            key, n = _summed(held)
            yield from rows(key >> 32, key & 0xFFFFFFFF, n)

        for _, block in _blocks(batches, tool):
            vector += np.bincount(block.link_a[block.regular], minlength=len(vector))
            odd = ~block.regular
            held.append(block.link_a[odd] << 32 | block.link_b[odd])
            room += len(held[-1])
            if room >= HELD_LINKS:
                yield from emptied()
                held, room = [], 0
        yield from emptied()
        known = np.flatnonzero(vector)
        yield from rows(known, np.full(len(known), -1), vector[known])  # -1: by the identity map

    found = written(in_batches(stored.select("a", "b"), work, "a long, b long, n long", arrow=True), "pair-parts")
    same = stored.sparkSession.createDataFrame(  # as many rows as the vocabulary has ids
        pd.DataFrame({"of": np.arange(len(pairing(*paths).same)), "same": pairing(*paths).same}), "of long, same long"
    )
    regular = found.where(F.col("b") == -1).groupBy("a").agg(F.sum("n").alias("n"))
    regular = regular.join(F.broadcast(same), F.col("a") == F.col("of")).select("a", F.col("same").alias("b"), "n")
    other = found.where(F.col("b") >= 0).groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = written(other.unionByName(regular).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = total.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))
    out = written(total.join(most, F.col("b") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(found, total)
    return out


def digests(stored: DataFrame, counts: DataFrame, path_a: str | None = None, path_b: str | None = None,
            table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; zeros and '' without tokens."""
    paths = _paths(path_a, path_b)
    tool = pairing(*paths)
    spark = stored.sparkSession
    small = counts.count() <= table_pairs
    same = tool.same
    known = spark.createDataFrame(pd.DataFrame({"x": np.flatnonzero(same >= 0), "y": same[same >= 0]}), "x long, y long")
    regular = counts.join(F.broadcast(known), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "n", "best").toPandas()
    n_same, best_same = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    n_same[regular["a"]], best_same[regular["a"]] = regular["n"], regular["best"]
    key, n, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if small:
        found = counts.toPandas()
        key = (found["a"].to_numpy(np.int64) << 32) | found["b"].to_numpy(np.int64)
        order = np.argsort(key)
        key, n, best = key[order], found["n"].to_numpy(np.int64)[order], found["best"].to_numpy(bool)[order]
    sent = spark.sparkContext.broadcast((n_same, best_same, key, n, best))
    plain = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def work(batches):
        tool = pairing(*paths)
        n_same, best_same, key, n, best = sent.value
        names = [f"{i}{mark}" for i in range(max(len(tool.size_a), len(tool.size_b))) for mark in ",|;"]
        for part, block in _blocks(batches, tool):
            own, top = n_same[block.link_a], best_same[block.link_a]
            odd = np.flatnonzero(~block.regular)
            pairs = block.link_a[odd] << 32 | block.link_b[odd]
            if small:
                at = np.searchsorted(key, pairs)
                own[odd], top[odd] = n[at], best[at]
            else:
                own[odd], top[odd] = 0, 0
            digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in block.spelled(names)]
            numbers = [block.n_a, block.n_b, block.n_groups, block.n_links, block.per_doc(top), block.per_doc(own)]
            columns = [part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in numbers], pa.array(digest, pa.string())]
            if not small:  # each document's irregular pairs travel with it, once each
                doc = np.searchsorted(block.links_to, odd, "right")
                lists = []
                for k in range(part.num_rows):
                    p, times = np.unique(pairs[doc == k] if part.num_rows == 1 else pairs[np.searchsorted(doc, k) : np.searchsorted(doc, k, "right")], return_counts=True)
                    lists.append([{"a": int(x) >> 32, "b": int(x) & 0xFFFFFFFF, "times": int(t)} for x, t in zip(p, times, strict=True)])
                columns.append(pa.array(lists, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["row_", "doc_id", *plain, "groups_sha256", *["odd"] * (not small)])

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"row_ long, doc_id {kind}, " + ", ".join(f"{c} long" for c in plain) + ", groups_sha256 string"
    schema += ", odd array<struct<a:bigint,b:bigint,times:bigint>>" * (not small)
    out = in_batches(stored, work, schema, arrow=True)
    if not small:
        out = written(out, "alignment", compression="zstd")
        links = out.select("row_", F.explode("odd").alias("p")).select(F.col("row_").alias("of"), "p.*")
        totals = counts.select(F.col("a").alias("x"), F.col("b").alias("y"), "n", F.col("best").cast("long").alias("top"))
        links = links.join(totals, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
        links = links.groupBy("of").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("top")).alias("tops"))
        out = out.drop("odd").join(links, F.col("row_") == F.col("of"), "left")
        out = out.withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
        out = out.withColumn("n_best", F.col("n_best") + F.coalesce("tops", F.lit(0)))
    return out.select("doc_id", *plain, "groups_sha256")


def groups(stored: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, groups): the groups of every document in order, each with its A ids and its B ids."""
    paths = _paths(path_a, path_b)

    def work(batches):
        tool = pairing(*paths)
        names = [f"{i}{mark}" for i in range(max(len(tool.size_a), len(tool.size_b))) for mark in ",|;"]
        for part, block in _blocks(batches, tool):
            lists = []
            for text in block.spelled(names):
                sides = [g.split("|") for g in text.split(";")] if text else []
                lists.append([{"a": [int(i) for i in a.split(",")], "b": [int(i) for i in b.split(",")]} for a, b in sides])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lists, kind)], names=["doc_id", "groups"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return in_batches(stored, work, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>", arrow=True)


def query(spark, sf_dir: str) -> DataFrame:
    stored = tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(stored, pair_counts(stored))
