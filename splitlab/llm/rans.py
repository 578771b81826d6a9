"""Token ids in files of static range asymmetric numeral systems (rANS), and reading them back.

Documents are dealt by ranges of doc_id; each range writes segments of about ``SEGMENT_TOKENS`` ids, whole
documents each, as rows of a stored table (its ``payload`` is the file format below), so writers and readers
need only what Spark reads and writes. A segment has one frequency table that all its blocks share.

Payload, little-endian: magic, then eight 32-bit numbers (documents, tokens, blocks, lanes, scale bits, and the
bytes of table, directory and checkpoints), the three deflated parts, then the blocks.
  table        distinct ids (uint32), their scaled frequencies (uint32)
  directory    doc_id (int64), null mark (uint8), tokens (uint32) of each document
  checkpoints  byte offset (uint64), first token, tokens, crc32 of the ids (uint32) of each block
  block        final states of the lanes (uint64), then 32-bit words in reading order
A block is decoded from its checkpoint alone; lane k holds tokens k, k + lanes, … of it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlab.llm.frames import in_batches, pick, shuffle_width
from splitlab.session import written

MAGIC = b"SLRANS01"
LANES, BLOCK_TOKENS, SEGMENT_TOKENS = 2048, 1 << 18, 1 << 20
END_ID = 2
#: Chunks that a worker's memo holds, at most, and an eighth as many pieces of chunks that are no plain words.
MAX_CHUNKS = 1_400_000
_WHITE = re.compile(r"\s")
_LATIN_END = "\u0250"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of the present ids that sum to 2**bits, each at least 1."""
    total = 1 << bits
    out = np.maximum(1, counts * (total - len(counts)) // max(counts.sum(), 1)).astype(np.int64)
    excess = int(out.sum()) - total
    order = np.argsort(-out, kind="stable")
    if excess < 0:
        out[order[0]] -= excess
    at = 0
    while excess > 0:  # flat tables only: take from the largest in turn
        take = min(excess, int(out[order[at]]) - 1)
        out[order[at]] -= take
        excess -= take
        at += 1
    return out


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> bytes:
    """States and words of one block; ``symbols`` are places in the table."""
    lanes, shift = np.full(LANES, _LOW, np.uint64), np.uint64(bits)
    f, c = freq[symbols], start[symbols]
    limit = f << np.uint64(63 - bits)
    words: list[np.ndarray] = []
    for low in range((len(symbols) - 1) // LANES * LANES, -1, -LANES):
        high = min(low + LANES, len(symbols))
        x = lanes[: high - low]
        full = x >= limit[low:high]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        own = f[low:high]
        whole = x // own
        lanes[: high - low] = (whole << shift) + (x - whole * own) + c[low:high]
    return lanes.tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, tokens: int, freq: np.ndarray, start: np.ndarray, lookup: np.ndarray, bits: int) -> np.ndarray:
    lanes = np.frombuffer(data, np.uint64, LANES).copy()
    words = np.frombuffer(data, np.uint32, offset=8 * LANES).astype(np.uint64)
    out = np.empty(tokens, np.int64)
    mask, shift, at = np.uint64((1 << bits) - 1), np.uint64(bits), 0
    for low in range(0, tokens, LANES):
        high = min(low + LANES, tokens)
        x = lanes[: high - low]
        slot = x & mask
        symbol = lookup[slot]
        x = freq[symbol] * (x >> shift) + slot - start[symbol]
        more = np.flatnonzero(x < _LOW)
        x[more] = (x[more] << _WORD) | words[at : at + len(more)]
        at += len(more)
        lanes[: high - low] = x
        out[low:high] = symbol
    return out


def encode_segment(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """Payload of whole documents; ``ids`` hold at least the end id each."""
    tokens = np.concatenate(ids).astype(np.uint32)
    counts = np.bincount(tokens)
    known = np.flatnonzero(counts).astype(np.uint32)
    place = np.zeros(len(counts), np.int64)
    place[known] = np.arange(len(known))
    symbols, counts = place[tokens], counts[known]
    bits = max(16, int(len(known)).bit_length() + 1)
    freq = scaled(counts, bits).astype(np.uint64)
    start = np.cumsum(freq) - freq
    blocks, checks, at = [], [], 0
    for first in range(0, len(tokens), BLOCK_TOKENS):
        part = slice(first, min(first + BLOCK_TOKENS, len(tokens)))
        block = encode_block(symbols[part], freq, start, bits)
        checks.append((at, first, part.stop - first, zlib.crc32(tokens[part].tobytes())))
        blocks.append(block)
        at += len(block)
    missing = np.array([x is None for x in doc_ids], np.uint8)
    table = zlib.compress(known.tobytes() + freq.astype(np.uint32).tobytes())
    keys = np.array([0 if x is None else x for x in doc_ids], np.int64)
    directory = zlib.compress(keys.tobytes() + missing.tobytes() + np.array([len(x) for x in ids], np.uint32).tobytes())
    points = zlib.compress(b"".join(struct.pack("<QIII", *c) for c in checks))
    sizes = (len(doc_ids), len(tokens), len(blocks), LANES, bits, len(table), len(directory), len(points))
    return b"".join([MAGIC, struct.pack("<8I", *sizes), table, directory, points, *blocks])


class Segment:
    """Reads a payload; each block by itself or all of them. A damaged one raises ``ValueError``."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token segment")
        docs, self.tokens, blocks, lanes, self.bits, table, directory, points = struct.unpack_from("<8I", payload, 8)
        if lanes != LANES:
            raise ValueError(f"{lanes} lanes")
        at = 40
        raw = zlib.decompress(payload[at : at + table])
        self.known = np.frombuffer(raw, np.uint32, len(raw) // 8)
        self.freq = np.frombuffer(raw, np.uint32, offset=len(raw) // 2).astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.lookup = np.repeat(np.arange(len(self.known)), self.freq.astype(np.int64))
        at += table
        raw = zlib.decompress(payload[at : at + directory])
        self.doc_ids = np.frombuffer(raw, np.int64, docs)
        self.missing = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, np.uint32, docs, 9 * docs).astype(np.int64)
        at += directory
        raw = zlib.decompress(payload[at : at + points])
        self.points = [struct.unpack_from("<QIII", raw, 20 * i) for i in range(blocks)]
        self.data = memoryview(payload)[at + points :]

    def block(self, i: int) -> np.ndarray:
        offset, _, tokens, crc = self.points[i]
        end = self.points[i + 1][0] if i + 1 < len(self.points) else len(self.data)
        found = decode_block(bytes(self.data[offset:end]), tokens, self.freq, self.start, self.lookup, self.bits)
        ids = self.known[found]
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {i}: wrong checksum")
        return ids

    def all(self) -> np.ndarray:
        parts = [self.block(i) for i in range(len(self.points))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Memo(dict):
    """Results by text, at most ``limit``; those not asked for again leave after two rounds."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, text: str):
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) < 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Whole texts to ids, as bytes, with the tokenizers library's model and memos of chunks and pieces.

    Added tokens of the vocabulary, such as <|endoftext|>, are matched in a text as the library does by default, and
    what stands between them is encoded by itself. The pattern that splits texts puts one space in front of what follows it, so a text may be cut before any space
    that something solid follows, and the chunks encoded each by itself. A chunk that is empty or begins with
    white space has no encoding of its own; texts with such chunks are encoded as a whole.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, limit: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        added = self.tool.get_added_tokens_decoder()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        # the leftmost match, and the longest of those
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self.model, self.split = self.tool.model, regex.compile(pattern).findall
        # byte-level vocabularies spell printable bytes as themselves and the others as 256, 257, …
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.spelling = {b: 256 + i for i, b in enumerate(hidden)}
        self.space, self.tokenize = chr(self.spelling[32]), self.model.tokenize
        self.pieces = Memo(self._piece, limit // 8)
        self.chunks = Memo(self._chunk, limit)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.space)
        else:
            spelled = piece.encode().decode("latin-1").translate(self.spelling)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        # the commonest shapes, split as the pattern would; what versions of Unicode may see differently is left to it
        if chunk.isascii() and chunk.isalpha():  # a plain word is one piece, held as a chunk alone
            return array("I", [t.id for t in self.tokenize(self.space + chunk)]).tobytes()
        if not chunk or _WHITE.match(chunk):
            return None
        word, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,;" else (chunk, "")
        if word.isalpha() and max(word) < _LATIN_END:
            return self.chunks[word] + self.pieces[mark] if mark else self._piece(" " + word)
        return b"".join(map(self.pieces.__getitem__, self.split(" " + chunk)))

    def encode(self, text: str) -> bytes:
        if not any(name in text for name in self.added):
            return self._plain(text)
        if self.whole:  # some match more or less than their string
            return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.cut(text)
        return b"".join(self.added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        parts = list(map(self.chunks.__getitem__, rest))
        if None in parts:
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        return b"".join(map(self.pieces.__getitem__, self.split(head))) + b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str | None = None, doc_id="doc_id", text="text", end_id: int = END_ID) -> DataFrame:
    """The stored segments (range_, seq, docs, tokens, payload) of all whole texts in ascending doc_id, nulls first.

    Null and empty texts are the end id alone. Repeated ids stand together, ordered by their texts' hash. An empty
    table has no segments; other columns are left behind. doc_id is a whole number.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def work(batches):
        tool, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys, ids, held, last = [], [], 0, np.uint32(end_id).tobytes()

        def segment():
            payload = encode_segment(keys, ids)
            return pd.DataFrame({"range_": [part], "seq": [seq], "docs": [len(keys)], "tokens": [held], "payload": [payload]})

        for batch in batches:
            for key, value in zip(batch["id"], batch["text"], strict=True):
                keys.append(None if key is None else int(key))
                ids.append(np.frombuffer(tool.encode(value or "") + last, np.uint32))
                held += len(ids[-1])
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield segment()

    rows = pick(docs, doc_id, text).toDF("id", "text")
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_width(docs), *order)
    rows = rows.sortWithinPartitions(*order).select(F.col("id").cast("long").cast("string").alias("id"), "text")
    return written(in_batches(rows, work, "range_ int, seq int, docs long, tokens long, payload binary"), "tokens")


def read_tokens(segments: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the segments, and its ids if asked for.

    Starts come from one number per range and, within a range, from its segments in order.
    """
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = segments.groupBy("range_").agg(F.sum("tokens").alias("own"))
    ranges = ranges.select(F.col("range_").alias("of"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select(
        F.col("range_").alias("in"), F.col("seq").alias("nth"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("off")
    )
    places = places.join(F.broadcast(ranges), F.col("in") == F.col("of")).select("in", "nth", (F.col("base") + F.col("off")).alias("first"))

    def work(batches):
        for batch in batches:
            for first, payload in zip(batch["first"], batch["payload"], strict=True):
                part = Segment(payload)
                tokens = part.all()
                ends = np.cumsum(part.lengths)
                starts = ends - part.lengths
                out = pd.DataFrame(
                    {
                        "doc_id": pd.array(part.doc_ids, "Int64"),
                        "start": int(first) + starts,
                        "n_tokens": part.lengths,
                        "ids_crc32": [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                    }
                )
                out.loc[part.missing, "doc_id"] = pd.NA
                if ids:
                    out["ids"] = [tokens[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)]
                yield out

    rows = segments.join(places, (F.col("range_") == F.col("in")) & (F.col("seq") == F.col("nth"))).select("first", "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return in_batches(rows, work, schema + ", ids array<int>" * ids)


def query(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
