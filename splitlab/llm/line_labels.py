"""Quality rules with a line labeller: a linear-chain CRF marks lines as content or boilerplate.

Counts per text come from ``TextBlock``. Each line that holds a word gets binary features; the chain's best
labels (Viterbi) say which words are content, and their share decides. The CRF is trained on the lines of a
bounded sample of labelled documents, whose lines take their document's label: noisy for single lines, right
for most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlab.llm.frames import pick, with_ids
from splitlab.llm.textblock import TextBlock, blocks, mixed, windows

#: Labelled documents that the CRF is trained on, at most.
TRAIN_DOCS, TRAIN_LINES = 4000, 200_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"

_SYMBOL, _DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_DIGIT[list(b"0123456789")] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_STOP[list(b".,;:!?")] = True

#: (measure, limits): a line has one feature for each limit that the measure reaches.
MEASURES = (
    ("words", (2, 4, 8, 16, 32, 64)),
    ("symbols_per_word", (0.05, 0.2, 0.5, 1.0)),
    ("digits_per_char", (0.05, 0.2, 0.5)),
    ("capitals_per_word", (0.1, 0.3, 0.6)),
    ("stops_per_word", (0.01, 0.05, 0.1, 0.3)),
    ("chars_per_word", (3, 4, 5, 7, 9, 12)),
    ("short_words", (0.05, 0.15, 0.3, 0.5)),
    ("repeats", (0.05, 0.2, 0.5)),
    ("same_as_before", (0.1, 0.3, 0.6)),
    ("copies", (1,)),
)
N_FEATURES = 1 + sum(len(limits) for _, limits in MEASURES)


@dataclass
class Lines:
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(block: TextBlock) -> tuple[pd.DataFrame, Lines]:
    """Counts of each text, and its lines that hold words."""
    words, doc = block.word_hashes(), block.word_doc
    text_key = mixed(np.arange(block.docs, dtype=np.uint64) + np.uint64(1))
    chars = (block.data & 0xC0) != 0x80
    symbol = _SYMBOL[block.data]

    first, value = windows(words, doc, 3)
    _, inverse, counts = np.unique(mixed(value + text_key[doc[first]]), return_inverse=True, return_counts=True)
    again = first[counts[inverse] > 1]
    repeated = np.zeros(len(words) + 2, bool)
    for k in range(3):
        repeated[again + k] = True
    repeated = repeated[: len(words)]

    starts, ends, line_doc, line_hash = block.lines()
    line_of = np.searchsorted(starts, block.starts, "right") - 1
    per_line = np.bincount(line_of, minlength=len(starts))
    held = np.flatnonzero(per_line)
    _, seen = np.unique(mixed(line_hash[held] + text_key[line_doc[held]]), return_index=True)
    copied = np.ones(len(held), bool)
    copied[seen] = False

    counts = pd.DataFrame(
        {
            "n_words": block.words_of(),
            "word_chars": block.per_doc(block.solid & chars),
            "n_symbols": block.per_doc(symbol),
            "n_dup_lines": np.bincount(line_doc[held][copied], minlength=block.docs),
            "n_repeat_words": np.bincount(doc[repeated], minlength=block.docs),
        }
    ).astype("int64")

    def on_lines(marks):
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[ends[held]] - total[starts[held]]

    def on_words(marks):
        return np.bincount(line_of, weights=marks, minlength=len(starts))[held]

    n = per_line[held].astype(float)
    size = on_lines(block.solid & chars).astype(float)
    same = np.zeros(len(words), bool)
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    values = {
        "words": n,
        "symbols_per_word": on_lines(symbol) / n,
        "digits_per_char": on_lines(_DIGIT[block.data]) / size,
        "capitals_per_word": on_lines(_UPPER[block.data]) / n,
        "stops_per_word": on_lines(_STOP[block.data]) / n,
        "chars_per_word": size / n,
        "short_words": on_words(block.ends - block.starts <= 3) / n,
        "repeats": on_words(repeated) / n,
        "same_as_before": on_words(same) / n,
        "copies": copied.astype(float),
    }
    columns = [np.ones(len(held), bool)] + [values[name] >= limit for name, limits in MEASURES for limit in limits]
    return counts, Lines(line_doc[held], n.astype(np.int64), np.stack(columns, 1))


def _by_length(doc: np.ndarray):
    """Lines as a matrix: (order of texts by falling number of lines, first line and number of lines of each)."""
    ids, first, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    return ids[order], first[order], count[order]


def viterbi(scores: np.ndarray, turns: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best label of every line; ``scores`` are lines × 2, ``turns`` label × next label, ``doc`` ascending.

    All texts go step by step together: at step t, those with more than t lines. Label 1 (content) wins ties.
    """
    out = np.zeros(len(doc), np.int8)
    if not len(doc):
        return out
    _, first, count = _by_length(doc)
    best = scores.copy()
    came = np.zeros(scores.shape, np.int8)
    for t in range(1, count[0]):
        at = first[: np.searchsorted(-count, -t, "left")] + t
        ways = best[at - 1][:, :, None] + turns[None]
        pick_one = ways[:, 1] >= ways[:, 0]
        came[at] = pick_one
        best[at] = scores[at] + np.where(pick_one, ways[:, 1], ways[:, 0])
    last = first + count - 1
    out[last] = best[last, 1] >= best[last, 0]
    for t in range(count[0] - 1, 0, -1):
        at = first[: np.searchsorted(-count, -t, "left")] + t
        out[at - 1] = came[at, out[at]]
    return out


@dataclass
class Model:
    weights: np.ndarray  # features × 2
    turns: np.ndarray  # label × next label

    def content(self, lines: Lines, docs: int) -> np.ndarray:
        """Words in lines labelled content, per text."""
        label = viterbi(lines.features @ self.weights, self.turns, lines.doc)
        return np.bincount(lines.doc, weights=lines.words * label, minlength=docs)


def fit(features: np.ndarray, label: np.ndarray, doc: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Gradient ascent with adaptive steps on the likelihood of the label chains; texts in ascending ``doc``."""
    x = features.astype(float)
    truth = np.eye(2)[label]
    weights, turns = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    _, first, count = _by_length(doc)
    texts = len(first)
    steps = [first[: np.searchsorted(-count, -t, "left")] + t for t in range(count[0])]
    last = first + count - 1
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    seen_turns = np.zeros((2, 2))
    np.add.at(seen_turns, (label[pairs], label[pairs + 1]), 1)
    squares_w, squares_t = np.full(weights.shape, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        scores = x @ weights
        ahead = scores.copy()
        for at in steps[1:]:
            ahead[at] += np.logaddexp.reduce(ahead[at - 1][:, :, None] + turns[None], axis=1)
        behind = np.zeros_like(scores)
        for at in steps[:0:-1]:
            behind[at - 1] = np.logaddexp.reduce(turns[None] + (scores[at] + behind[at])[:, None, :], axis=2)
        total = np.zeros(len(doc))
        norm = np.logaddexp.reduce(ahead[last], axis=1)
        total[:] = np.repeat(norm[np.argsort(first)], count[np.argsort(first)])
        share = np.exp(ahead + behind - total[:, None])
        joint = np.exp(
            ahead[pairs][:, :, None] + turns[None] + (scores + behind)[pairs + 1][:, None, :] - total[pairs][:, None, None]
        ).sum(0)
        step_w = x.T @ (truth - share) / texts - decay * weights
        step_t = (seen_turns - joint) / texts - decay * turns
        squares_w += step_w**2
        squares_t += step_t**2
        weights += 0.5 * step_w / np.sqrt(squares_w)
        turns += 0.5 * step_t / np.sqrt(squares_t)
    return Model(weights, turns)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, doc_id="doc_id", text="text",
          label_id="doc_id", quality="quality", most_lines: int = TRAIN_LINES) -> Model | None:
    """The CRF of a sample of at most ``limit`` labelled documents with ``most_lines`` lines in all, the same on every run.

    Documents are taken in the order of a hash of their ids, and of their texts where an id repeats, until one would
    be too many; equal rows count once.

    Null without two kinds of labels: then nothing is known of boilerplate.
    """
    spread = F.xxhash64(F.col("label_id"))
    chosen = (
        pick(labels, label_id, quality)
        .toDF("label_id", "quality")
        .dropna()
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(spread, "label_id")
        .limit(limit)
    )

    def work(batches):
        for batch in batches:
            texts = list(batch["text"])
            for a, b in blocks(texts):
                _, lines = measure(TextBlock(texts[a:b]))
                yield pd.DataFrame(
                    {
                        "id": batch["id"].to_numpy()[a + lines.doc],
                        "label": batch["quality"].to_numpy()[a + lines.doc].astype("int32"),
                        "bits": [row.tobytes() for row in np.packbits(lines.features, axis=1)],
                    }
                )

    rows = pick(docs, doc_id, text).toDF("id", "text")
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    rows = rows.select("id", "text", "quality", lines.alias("lines"), F.xxhash64("text").alias("tie"))
    # the order of the sample is that of its ids and texts; places in it are the sums of lines up to each row
    order = Window.orderBy(F.xxhash64("id"), "id", "tie")
    short = rows.select("id", "tie", "lines").orderBy(F.xxhash64("id"), "id", "tie").limit(2 * limit)
    short = short.withColumn("to", F.sum("lines").over(order)).where(F.col("to") <= most_lines)
    short = short.groupBy(F.col("id").alias("id_"), F.col("tie").alias("tie_")).agg(F.count("*").alias("times"))
    rows = rows.join(F.broadcast(short), (F.col("id") == F.col("id_")) & (F.col("tie") == F.col("tie_"))).dropDuplicates(["id", "tie"])
    rows = rows.select(F.concat_ws(":", "id", "tie").alias("id"), "text", "quality")
    found = with_ids(rows, "id", work, "id", "label int, bits binary").toPandas()
    if found["label"].nunique() < 2:
        return None
    found["doc"] = found["id"].rank(method="dense").astype("int64")
    found = found.sort_values("doc", kind="stable")
    bits = np.frombuffer(b"".join(found["bits"]), np.uint8).reshape(len(found), -1)
    features = np.unpackbits(bits, axis=1)[:, :N_FEATURES]
    return fit(features, found["label"].to_numpy().clip(0, 1), found["doc"].to_numpy())


def label_documents(docs: DataFrame, model: Model | None, doc_id="doc_id", text="text",
                    min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, content_words, base_failed and kept of every whole text.

    Null and empty texts have no words and fail. Repeated rows are judged each by itself, ties of labels go to
    content, an empty table gives no rows, other columns are left behind. Without a model the base rules decide.
    """

    def work(batches):
        for batch in batches:
            texts = list(batch[text])
            for a, b in blocks(texts):
                out, lines = measure(TextBlock(texts[a:b]))
                n = out["n_words"]
                content = model.content(lines, b - a) if model else n.to_numpy()
                out["content_words"] = content.astype("int64")
                out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                out["kept"] = ~out["base_failed"] & (content >= min_content * n)
                out.insert(0, "doc_id", batch[doc_id].to_numpy()[a:b])
                yield out

    rows = pick(docs, doc_id, text)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long"
    return with_ids(rows, doc_id, work, "doc_id", f"{counts}, base_failed boolean, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
