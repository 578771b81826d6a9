"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into words. Within a language a
phrase of 2 to 5 words is a candidate if it occurs at least ``LEAST`` times, overlaps included.

Words are counted first, exactly. Phrases then take two passes over the texts.
* First pass, two words and then three to five: every task adds up the keys (64 bits of language and words) of its phrases
  and deals them by hash to partitions, whose number grows with the corpus. Each partition keeps one Misra-Gries
  summary: when it holds more keys than its capacity, the count of the first key too many is taken from all, and keys
  without a rest leave. Summaries of runs merge the same way. What a count lacks is at most mass / (capacity + 1), and
  the capacity exceeds mass / LEAST, so no frequent phrase is lost.
* Second pass: phrases whose key survived are counted by their words, exactly.
A phrase can be frequent only if its words are, and a longer one only if its pairs are; others are left out before they are
dealt. That test is a bit table of fixed size per level, made by Spark from the survivors: a wrong yes costs a counter, never a
result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlab.llm.frames import in_batches, pick, shuffle_width
from splitlab.llm.textblock import mixed
from splitlab.session import discard, written

LEAST, LONGEST, TOP, COVER = 100, 5, 2000, 100
#: Phrase occurrences for each hash partition; a summary of them holds about a hundredth of that.
PARTITION_MASS = 8_000_000
#: Bits of the table of possible words or pairs, 16 MB whatever the corpus.
TABLE_BITS = 1 << 27
_BUCKET = 32_768
#: Words that a task keeps numbered, keys that it adds up before it deals them, phrases that it counts by their words.
HELD_WORDS, HELD_KEYS, HELD_PHRASES = 400_000, 3_000_000, 300_000
#: Texts of a batch are joined to blocks of about so many bytes, a longer text by itself.
BLOCK_BYTES = 1 << 20
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)


class Words(dict):
    """Numbers for the words of one language, from 1; 0 is the end of a piece. ``keys`` are 64 bits of each word.

    The keys equal Spark's xxhash64(lang, word).
    """

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.lang = lang
        self[_BREAK] = 0
        self.spelled = [_BREAK]
        self.hashes = [0]
        self._keys = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.spelled)
        self.spelled.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number

    @property
    def keys(self) -> np.ndarray:
        if len(self._keys) < len(self.hashes):
            self._keys = np.concatenate([self._keys, np.array(self.hashes[len(self._keys) :], np.uint64)])
        return self._keys

    def read(self, texts: list[bytes]) -> np.ndarray:
        """The numbers of the words of the texts, with 0 behind every piece."""
        joined = _BREAK.join([*texts, b""]).translate(_FOLD).replace(_BREAK, b" \xff ")
        tokens = joined.split()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class Languages(dict):
    """The words of each language that a task has met; it clears them when they are too many."""

    def __missing__(self, lang: str) -> Words:
        self[lang] = Words(lang)
        return self[lang]

    def crowded(self) -> bool:
        return sum(len(words.spelled) for words in self.values()) > HELD_WORDS

    def blocks(self, batches):
        """(words of the language, numbers) of blocks of the texts of Arrow batches with columns lang, text."""
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            held: dict[str, list[bytes]] = {}
            room: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                held.setdefault(lang, []).append(text)
                room[lang] += len(text) + 1
                if room[lang] >= BLOCK_BYTES:
                    yield self[lang], self[lang].read(held.pop(lang))
                    room[lang] = 0
            for lang, rest in held.items():
                yield self[lang], self[lang].read(rest)


def _phrase_keys(keys: np.ndarray, solid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of the ``size`` words from each place, whether they lie within one piece)."""
    n = len(keys) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    value, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        value = mixed(value + keys[k : k + n])
        whole &= solid[k : k + n]
    return value, whole


def _possible(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(TABLE_BITS - 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(rows: DataFrame, key: str) -> np.ndarray:
    """A table of TABLE_BITS bits with those of the keys set; the driver sees its buckets only, at most 16 MB."""
    place = F.col(key).bitwiseAND(F.lit(TABLE_BITS - 1))
    rows = rows.select(F.shiftright(place, 15).alias("bucket"), (place % _BUCKET).alias("bit"))
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for bucket, bits in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():
        table[bucket * _BUCKET // 8 : (bucket + 1) * _BUCKET // 8] = np.frombuffer(bits, np.uint8)
    return table


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word; a task adds up its words before they are shuffled."""

    def work(batches):
        known = Languages()
        counts: dict[str, np.ndarray] = {}

        def emptied(words):
            n = counts.pop(words.lang, np.zeros(0, np.int64))
            at = np.flatnonzero(n)
            at = at[at > 0]
            spelled = words.spelled
            names = pa.array([spelled[i] for i in at.tolist()], pa.binary()).cast(pa.string())
            lang = pa.array([words.lang] * len(at), pa.string())
            return pa.RecordBatch.from_arrays([lang, names, pa.array(n[at])], names=["lang", "phrase", "f"])

        for words, numbers in known.blocks(batches):
            more = np.bincount(numbers, minlength=len(words.spelled))
            old = counts.get(words.lang)
            if old is not None:
                more[: len(old)] += old
            counts[words.lang] = more
            if known.crowded():
                yield from map(emptied, known.values())
                known.clear()
        yield from map(emptied, known.values())

    found = in_batches(texts, work, "lang string, phrase string, f long", arrow=True)
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Summary:
    """A Misra-Gries summary: after any adds and merges every key's true count is in [count, count + lost]."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.room = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.room += len(keys)
        if self.room >= max(self.capacity, 1 << 20):
            self.settle()

    def merge(self, other: Summary) -> None:
        other.settle()
        self.lost += other.lost
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.room = [], 0
        keys, counts = _added(keys, counts)
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            counts = counts - off
            left = counts > 0
            keys, counts, self.lost = keys[left], counts[left], self.lost + off
        self.keys, self.counts = keys, counts

    def possible(self, least: int) -> np.ndarray:
        """Keys whose true count may reach ``least``."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def dealt_keys(texts: DataFrame, table, sizes: tuple[int, ...], parts: int) -> DataFrame:
    """(part, mass, keys, counts): packed runs of the keys of phrases of these sizes, added up within a task.

    ``table`` is a broadcast bit table: of words for phrases of two words, of pairs for longer ones.
    """

    def work(batches):
        known = Languages()
        held: list[np.ndarray] = []
        room = 0

        def packed():
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            keys, counts = _added(keys, np.ones(len(keys), np.int64))
            # the upper 32 bits deal the keys, so a part is a range of the sorted run
            part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else [0]
            rows = [
                (int(part[a]), int(counts[a:b].sum()), keys[a:b].tobytes(), counts[a:b].tobytes())
                for a, b in zip(edges[:-1], edges[1:], strict=True)
            ]
            return pd.DataFrame(rows, columns=["part", "mass", "keys", "counts"])

        bits = table.value
        for words, numbers in known.blocks(batches):
            solid = numbers > 0
            keys = words.keys[numbers]
            if sizes == (2,):
                solid &= _possible(bits, keys)
                pair = None
            else:
                value, whole = _phrase_keys(keys, solid, 2)
                pair = np.flatnonzero(whole)
                pair = pair[_possible(bits, value[pair])]
            for size in sizes:
                if pair is None:
                    value, whole = _phrase_keys(keys, solid, size)
                    found = value[whole]
                else:
                    first = _in_row(pair, size - 1)
                    found = _keys_at(keys, first, size)
                held.append(found)
                room += len(found)
            if room >= HELD_KEYS:
                yield from _tables(packed())
                held, room = [], 0
            if known.crowded():
                known.clear()
        yield from _tables(packed())

    return in_batches(texts, work, "part int, mass long, keys binary, counts binary", arrow=True)


def _tables(frame: pd.DataFrame):
    schema = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    yield from pa.Table.from_pandas(frame, schema, preserve_index=False).to_batches(max_chunksize=256)


def _in_row(pair: np.ndarray, pairs: int) -> np.ndarray:
    """Places from which ``pairs`` pairs follow each other."""
    n = len(pair) - pairs + 1
    return pair[:n][pair[pairs - 1 :] - pair[:n] == pairs - 1] if n > 0 else pair[:0]


def _keys_at(keys: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(len(first), np.uint64)
    for k in range(size):
        value = mixed(value + keys[first + k])
    return value


def possible_keys(packed: DataFrame, parts: int, least: int) -> DataFrame:
    """(key) of every phrase that may occur ``least`` times: one summary for each hash partition."""
    mass = packed.groupBy(F.col("part").alias("of_")).agg(F.sum("mass").alias("all_"))
    # broadcast (a row a part): after a shuffled join Spark leaves out the repartition and may then read parts in pieces
    rows = packed.join(F.broadcast(mass), F.col("part") == F.col("of_"))
    rows = rows.select("part", (F.floor(F.col("all_") / least) + 1).cast("long").alias("capacity"), "keys", "counts")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part")

    def work(batches):
        now, summary = None, None

        def survivors():
            keys = summary.possible(least)
            for at in range(0, len(keys), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 20)].view(np.int64))], names=["key"])

        for batch in batches:
            for part, capacity, keys, counts in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if part != now:
                    if summary:
                        yield from survivors()
                    now, summary = part, Summary(capacity)
                summary.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
        if summary:
            yield from survivors()

    return in_batches(rows, work, "key long", arrow=True)


def exact_counts(texts: DataFrame, pairs, longer, longest: int) -> DataFrame:
    """(lang, phrase, words, f) of every phrase whose key is in the broadcast bit tables, counted by its words."""

    def work(batches):
        known = Languages()
        counts: dict[tuple[str, int], Counter] = {}
        pair_bits, longer_bits = pairs.value, longer.value

        def emptied():
            for (lang, size), found in counts.items():
                names = pa.array(list(found), pa.binary()).cast(pa.string())
                n = pa.array(list(found.values()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), names, pa.array([size] * len(names), pa.int32()), n],
                    names=["lang", "phrase", "words", "f"],
                )
            counts.clear()

        for words, numbers in known.blocks(batches):
            keys = words.keys[numbers]
            value, whole = _phrase_keys(keys, numbers > 0, 2)
            pair = np.flatnonzero(whole)
            pair = pair[_possible(pair_bits, value[pair])]
            for size in range(2, longest + 1):
                first = pair
                if size > 2:
                    first = _in_row(pair, size - 1)
                    first = first[_possible(longer_bits, _keys_at(keys, first, size))]
                found = counts.setdefault((words.lang, size), Counter())
                for phrase, n in _spelled(words.spelled, numbers, first, size):
                    found[phrase] += n
            if sum(map(len, counts.values())) >= HELD_PHRASES:
                yield from emptied()
            if known.crowded():
                known.clear()
        yield from emptied()

    found = in_batches(texts, work, "lang string, phrase string, words int, f long", arrow=True)
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _spelled(spelled: list[bytes], numbers: np.ndarray, first: np.ndarray, size: int):
    """(phrase, times) of the ``size`` words from each place; told apart by the words' numbers, not by keys."""
    code, codes = numbers[first], 0
    for k in range(1, size):  # numbers of distinct beginnings stay below the places', so nothing overflows
        if k > 1:
            _, code = np.unique(code, return_inverse=True)
        code = code * len(spelled) + numbers[first + k]
    codes, at, times = np.unique(code, return_index=True, return_counts=True)
    for place, n in zip(first[at].tolist(), times.tolist(), strict=True):
        yield b" ".join([spelled[i] for i in numbers[place : place + size].tolist()]), n


def frequent_phrases(docs: DataFrame, text="text", lang="lang", least: int = LEAST, longest: int = LONGEST,
                     partition_mass: int = PARTITION_MASS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more in
    their language, and (lang, n) with all word occurrences of each language.

    Null texts are empty, and a null language is the language ``und``; empty texts have no words. Repeated rows count
    each by itself. Without rows both tables are empty. Other columns are left behind.
    """
    spark = docs.sparkSession
    rows = pick(docs, lang, text).toDF("lang", "text")
    rows = rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(word_counts(rows), "words")
    mass = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(shuffle_width(docs), -(-total // partition_mass))
    single = words.where(F.col("f") >= least)
    send = spark.sparkContext.broadcast
    table = send(bit_table(single.select(F.xxhash64("lang", "phrase").alias("key")), "key"))

    def level(table, sizes):
        packed = written(dealt_keys(rows, table, sizes, parts), "phrase-keys")
        keys = written(possible_keys(packed, parts, least), "phrase-survivors")
        found = send(bit_table(keys, "key"))
        discard(packed, keys)
        return found

    pairs = level(table, (2,))
    longer = level(pairs, tuple(range(3, longest + 1))) if longest > 2 else pairs
    counted = written(exact_counts(rows, pairs, longer, longest).where(F.col("f") >= least), "phrases")
    single = single.select("lang", "phrase", F.lit(1).alias("words"), "f")
    return single.unionByName(counted), mass


def collocations(docs: DataFrame, text="text", lang="lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP,
                 cover: int = COVER, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases that are not covered by a longer one.

    A cut of a phrase into two parts of l and r occurrences scores floor(1000·a·n / (l·r)), in exact arithmetic; the
    lowest cut counts, of equal scores the one with the shorter first part. A phrase is covered if a longer
    candidate that holds it occurs at least ``cover`` percent as often. ``top`` is the number of phrases of each language
    that are reported, None for all. Rows as in ``frequent_phrases``.
    """
    phrases, mass = frequent_phrases(docs, text, lang, least, longest, partition_mass)
    many = phrases.where(F.col("words") > 1)
    part = F.split("phrase", " ")

    def spell(start, length):
        return F.array_join(F.slice(part, start, length), " ")

    # of longer phrases those with one word more are enough: each word less can only occur more often
    inner = many.where(F.col("words") > 2)
    ends = F.array(spell(F.lit(1), F.col("words") - 1), spell(F.lit(2), F.col("words") - 1))
    inner = inner.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most_"))
    many = many.join(inner, ["lang", "phrase"], "left").where(
        F.col("most_").isNull() | (100 * F.col("most_") < cover * F.col("f"))
    )
    cuts = many.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first_", spell(F.lit(1), F.col("k"))).withColumn("rest_", spell(F.col("k") + 1, F.col("words") - F.col("k")))
    left = phrases.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("phrase_l"), F.col("f").alias("l"))
    right = phrases.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("phrase_r"), F.col("f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("first_") == F.col("phrase_l")))
    cuts = cuts.join(right, (F.col("lang") == F.col("lang_r")) & (F.col("rest_") == F.col("phrase_r")))
    cuts = cuts.join(mass.withColumnRenamed("lang", "lang_n"), F.col("lang") == F.col("lang_n"))
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(18,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("rank", F.row_number().over(order))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of op13: every phrase of every piece, counted.
SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
s AS (
  SELECT DISTINCT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, a AS longer
  FROM (SELECT lang, w, a, j, unnest(range(1, len(w) - j + 2)) AS i
    FROM (SELECT lang, w, a, unnest(range(2, len(w))) AS j FROM c))),
o AS (
  SELECT c.* FROM c WHERE NOT EXISTS (
    SELECT 1 FROM s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.longer >= 100 * c.a)),
t AS (
  SELECT o.lang, o.phrase, a, cut, gl.f AS l, gr.f AS r, n.n,
    ((1000::HUGEINT * a * n.n) // (gl.f::HUGEINT * gr.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM o) o
  JOIN g gl ON gl.lang = o.lang AND gl.phrase = array_to_string(w[1 : cut], ' ') AND gl.k = cut
  JOIN g gr ON gr.lang = o.lang AND gr.phrase = array_to_string(w[cut + 1 :], ' ') AND gr.k = o.k - cut
  JOIN n ON n.lang = o.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM t),
q AS (
  SELECT lang, phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
