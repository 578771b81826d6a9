"""Personal data: base rules, and a semi-Markov CRF that cuts runs of number-like words into whole entities.

A unit is a run of ``[A-Za-z0-9@._%+()-]``; it is a possible part of an entity if it holds a digit or @. Entities
are up to ``MAX_UNITS`` such units with single spaces between, so all other text is outside by construction
and each run of units is decoded by itself: dynamic programming over (end, type) chooses boundaries and types
jointly, scoring whole candidate spans (valid check digits, number of digits, shape) and neighbouring types.

The weights come from likelihood training on runs of a bounded sample of documents whose base spans serve as
labels; pairs of runs are joined to teach boundaries that greedy rules miss. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.llm.frames import in_batches, pick, with_ids

KINDS = ("email", "ip", "card", "phone")
#: Documents whose runs train the weights, and distinct training runs, at most.
TRAIN_DOCS, TRAIN_RUNS = 20_000, 3_000
MAX_UNITS = 8

_EVIDENCE = re.compile(r"[0-9@]")
_UNIT = re.compile(r"[A-Za-z0-9@._%+()-]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CLASS = _LOCAL | frozenset("@()")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the first digit of its run and takes runs whole, so nothing is tried twice in long numbers.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _good_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _good_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _good_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def _emails(text: str):
    """Leftmost matches around each @: the local part is the whole run before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules, in order."""
    if not _EVIDENCE.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for kind, (rule, good) in enumerate(((_IP, _good_ip), (_CARD, _good_card), (_PHONE, _good_phone)), 1):
        found += [(m.start(), kind, m.end()) for m in rule.finditer(text) if good(m.group())]
    return sorted(found)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Units (start, end) that hold a digit or @, in groups with one space between neighbours."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while found := _EVIDENCE.search(text, at):
        start = found.start()
        while start > at and text[start - 1] in _CLASS:
            start -= 1
        end = _UNIT.match(text, start).end()
        if out and text[out[-1][-1][1] : start] == " ":
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        at = end
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation that cannot begin or end an entity."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    return start, end


FEATURES = (
    "always", "email", "has_at", "ip", "four_parts", "bad_parts", "card", "card_length", "card_bad", "sixteen",
    "phone", "plus", "phone_length", "parentheses", "grouped", "letters", "one_unit", "units_2_3", "units_4_up",
    "few_digits", "many_digits", "plus_inside", "joins_numbers",
)


def features(span: str, units: int) -> tuple[int, ...]:
    digits = digits_of(span)
    n = len(digits)
    letters = any(c.isalpha() for c in span)
    parts = span.split(".")
    four = len(parts) == 4 and all(p.isdigit() for p in parts)
    plain = not letters and all(c in "0123456789 -" for c in span) and span[:1].isdigit()
    card = plain and 12 <= n <= 19
    phone = bool(_PHONE.fullmatch(span)) and 9 <= n <= 15
    return tuple(
        map(
            int,
            (
                True, bool(_EMAIL.fullmatch(span)), "@" in span, four and _good_ip(span), four,
                four and not _good_ip(span), card and luhn(digits), card, card and not luhn(digits), n == 16,
                phone, span.startswith("+"), not letters and 9 <= n <= 15, "(" in span, "-" in span or " " in span,
                letters, units == 1, 2 <= units <= 3, units >= 4, n < 9, n > 19, "+" in span[1:],
                units > 1 and any(len(digits_of(u)) > 8 for u in span.split(" ")),
            ),
        )
    )


@dataclass
class Run:
    """Candidate spans by (first unit, units): their trimmed places and feature rows."""

    units: int
    spans: dict[tuple[int, int], tuple[int, int]]
    rows: dict[tuple[int, int], tuple[int, ...]]


def candidates(text: str, units: list[tuple[int, int]]) -> Run:
    spans, rows = {}, {}
    for i in range(len(units)):
        for k in range(1, min(MAX_UNITS, len(units) - i) + 1):
            start, end = trimmed(text, units[i][0], units[i + k - 1][1])
            if end > start and end > units[i + k - 1][0] and start < units[i][1]:
                spans[i, k] = (start, end)
                rows[i, k] = features(text[start:end], k)
    return Run(len(units), spans, rows)


class Model:
    """``weights`` feature × kind, ``turns`` from × to, both over kinds and outside as the last."""

    def __init__(self, weights: np.ndarray, turns: np.ndarray):
        self.weights, self.turns = weights, turns
        self._memo: dict[tuple[int, ...], list[float]] = {}

    def score(self, row: tuple[int, ...]) -> list[float]:
        known = self._memo.get(row)
        if known is None:
            known = self._memo[row] = (np.asarray(row) @ self.weights).tolist()
        return known

    def decode(self, run: Run) -> list[tuple[int, int, int]]:
        """Best segmentation: (first unit, units, kind) of its entities."""
        out = len(KINDS)
        turns = self.turns
        best = [[-math.inf] * (out + 1) for _ in range(run.units + 1)]
        came: list[list] = [[None] * (out + 1) for _ in range(run.units + 1)]
        best[0][out] = 0.0
        for end in range(1, run.units + 1):
            for k in range(1, min(MAX_UNITS, end) + 1):
                i = end - k
                row = run.rows.get((i, k))
                kinds = [(out, 0.0)] if k == 1 else []  # first, so that outside wins ties
                kinds += enumerate(self.score(row)) if row else ()
                for kind, score in kinds:
                    for before in range(out + 1):
                        total = best[i][before] + turns[before][kind] + score
                        if total > best[end][kind]:
                            best[end][kind] = total
                            came[end][kind] = (i, before)
        at = run.units
        kind = max(range(out, -1, -1), key=lambda y: best[at][y] + turns[y][out])
        found = []
        while at:
            i, before = came[at][kind]
            if kind != out:
                found.append((i, at - i, kind))
            at, kind = i, before
        return found[::-1]


def fit(examples: list[tuple[Run, dict[tuple[int, int], int], int]], rounds: int = 60, decay: float = 0.02) -> Model:
    """Likelihood ascent over (run, kind of each gold segment, times seen); unlisted units are outside."""
    out = len(KINDS)
    weights = np.zeros((len(FEATURES), out))
    turns = np.zeros((out + 1, out + 1))
    squares_w, squares_t = np.full(weights.shape, 1e-6), np.full(turns.shape, 1e-6)
    total = sum(times for *_, times in examples) or 1
    for _ in range(rounds):
        slope_w, slope_t = np.zeros_like(weights), np.zeros_like(turns)
        for run, gold, times in examples:
            n = run.units
            scores = {key: np.append(np.asarray(row) @ weights, -np.inf) for key, row in run.rows.items()}
            none = np.append(np.full(out, -np.inf), 0.0)
            for i in range(n):
                own = scores.get((i, 1))
                scores[i, 1] = none if own is None else np.append(own[:-1], 0.0)
            ahead = np.full((n + 1, out + 1), -np.inf)
            ahead[0, out] = 0.0
            entered = [np.logaddexp.reduce(ahead[0][:, None] + turns, axis=0)]
            for end in range(1, n + 1):
                ways = [entered[end - k] + scores[end - k, k] for k in range(1, min(MAX_UNITS, end) + 1) if (end - k, k) in scores]
                ahead[end] = np.logaddexp.reduce(ways, axis=0)
                entered.append(np.logaddexp.reduce(ahead[end][:, None] + turns, axis=0))
            norm = np.logaddexp.reduce(ahead[n] + turns[:, out])
            behind = np.full((n + 1, out + 1), -np.inf)  # after a segment of the type that ends here
            behind[n] = turns[:, out]
            for start in range(n - 1, -1, -1):
                ways = [scores[start, k] + behind[start + k] for k in range(1, min(MAX_UNITS, n - start) + 1) if (start, k) in scores]
                onward = np.logaddexp.reduce(ways, axis=0)
                behind[start] = np.logaddexp.reduce(turns + onward[None], axis=1)
                slope_t -= times * np.exp(ahead[start][:, None] + turns + onward[None] - norm)
            slope_t[:, out] -= times * np.exp(ahead[n] + turns[:, out] - norm)
            for (i, k), row in run.rows.items():
                share = np.exp(entered[i] + scores[i, k] + behind[i + k] - norm)[:out]
                slope_w -= times * np.outer(row, share)
            at, before = 0, out
            while at < n:
                key = next((key for key in gold if key[0] == at), None)
                kind = gold[key] if key else out
                slope_t[before, kind] += times
                if key:
                    slope_w[:, kind] += times * np.asarray(run.rows[key])
                at += key[1] if key else 1
                before = kind
            slope_t[before, out] += times
        slope_w = slope_w / total - decay / 100 * weights
        slope_t = slope_t / total - decay / 100 * turns
        squares_w += slope_w**2
        squares_t += slope_t**2
        weights += 0.5 * slope_w / np.sqrt(squares_w)
        turns += 0.5 * slope_t / np.sqrt(squares_t)
    return Model(weights, turns)


def _example(text: str, units: list[tuple[int, int]]):
    """(run, gold segments) if the base rules explain the run: every span is a candidate, or it is one unit."""
    run = candidates(text, units)
    low, high = units[0][0], units[-1][1]
    gold = {}
    for start, kind, end in base_spans(text[low:high]):
        key = next((key for key, span in run.spans.items() if span == (low + start, low + end)), None)
        if key is None or any(i < key[0] + key[1] and key[0] < i + k for i, k in gold):
            return None
        gold[key] = kind
    return (run, gold) if gold or len(units) == 1 else None


def train(docs: DataFrame, limit: int = TRAIN_DOCS, doc_id="doc_id", text="text") -> Model:
    """Weights from a sample of at most ``limit`` documents, the same on every run; without runs nothing is added."""
    rows = pick(docs, doc_id, text).toDF("id", "text")
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = rows.join(F.broadcast(chosen), "id", "left_semi").where(F.col("text").rlike("[0-9@]")).limit(2 * limit)

    def work(batches):
        for batch in batches:
            seen = Counter(t[u[0][0] : u[-1][1]] for t in batch["text"] for u in runs(t) if len(u) <= 2 * MAX_UNITS)
            yield pd.DataFrame({"run": list(seen), "times": list(seen.values())}).astype({"run": "str", "times": "int64"})

    found = (
        in_batches(rows.select("text"), work, "run string, times long").groupBy("run").agg(F.sum("times").alias("times"))
        .orderBy(F.xxhash64("run"), "run").limit(TRAIN_RUNS).toPandas()
    )
    single = [
        (value, *got, times)
        for value, times in zip(found["run"], found["times"], strict=True)
        if (got := _example(value, runs(value)[0]))
    ]
    joined = []  # neighbours keep the labels that each has alone
    for (a, run_a, gold_a, _), (b, run_b, gold_b, _) in zip(single[::2], single[1::2], strict=False):
        value = f"{a} {b}"
        groups = runs(value)
        if len(groups) == 1 and len(groups[0]) == run_a.units + run_b.units:
            gold = gold_a | {(i + run_a.units, k): kind for (i, k), kind in gold_b.items()}
            run = candidates(value, groups[0])
            if all(key in run.rows for key in gold):
                joined.append((value, run, gold, 1))
    merged: dict[tuple, list] = {}
    for _, run, gold, times in single + joined:
        key = (run.units, tuple(sorted(run.rows.items())), tuple(sorted(gold.items())))
        merged.setdefault(key, [run, gold, 0])[2] += int(times)
    return fit([(run, gold, times) for run, gold, times in merged.values()])


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind number, end): model spans that no base span of their kind covers join."""
    base = base_spans(text)
    # spans of one kind do not overlap, so only the last that begins no later can cover another
    held = [[(start, end) for start, y, end in base if y == kind] for kind in range(len(KINDS))]
    extra = []
    for units in runs(text):
        run = candidates(text, units)
        for i, k, kind in model.decode(run):
            start, end = run.spans[i, k]
            before = bisect_right(held[kind], start, key=itemgetter(0))
            if not before or end > held[kind][before - 1][1]:
                extra.append((start, kind, end))
    return base, sorted(base + extra)


def _named(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_documents(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """Counts of base spans, their digest and all spans of every whole text.

    Null texts count as empty and have none. Places are code points, ends exclusive. Repeated rows are searched
    each by itself; an empty table gives no rows; other columns are left behind.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for value in batch[text]:
                base, spans = find(value or "", model)
                kinds = [kind for _, kind, _ in base]
                digest = hashlib.sha256(_named(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in range(len(KINDS))], digest, _named(spans)))
            out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
            out.insert(0, "doc_id", batch[doc_id].to_numpy())
            yield out

    rows = pick(docs, doc_id, text)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return with_ids(rows, doc_id, work, "doc_id", f"{counts}, base_sha256 string, spans string")


def masked(text: str, model: Model) -> str:
    """The text with each entity replaced by its kind in angle brackets; overlapping ones become one, the first's."""
    _, spans = find(text, model)
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_documents(docs, train(docs))
