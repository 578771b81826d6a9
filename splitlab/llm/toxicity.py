"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

* Lexicon voters are words and word beginnings that labelled training documents show to be far likelier in toxic
  texts, and words far likelier in clean ones, which vote where no toxic term is found; pattern voters look at shape
  (masked or digit-spelled terms, address, shouting, one stray term in a long text, no term at all).
* The label model knows the votes only. Every voter has an accuracy, the chance that its vote is the class; pairs of
  voters that agree beyond what the class explains are correlated, and a forest of the strongest such pairs enters the
  posterior, so that two voters which always fire together count as one. EM finds both. Not to vote says nothing.
* A logistic classifier on term and pattern features is fitted to the posteriors and scores whole texts.

Labels choose the lexicon and give the class balance; they are no vote, so posteriors are checked against them. Both
fits use a sample of at most ``TRAIN_DOCS`` labelled documents, the same on every run. Labels, language, source and id
are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlab.llm.frames import in_batches, pick, shuffle_width, with_ids
from splitlab.session import discard, written

#: Labelled documents to learn from, at most; a third of them toxic where there are enough.
TRAIN_DOCS = 12_000
MAX_TERMS = 400
#: Votes that each voter is thought to have cast in either class before its own.
PSEUDO = 0.5
#: A term occurs in so many toxic sample documents at least, is so many times likelier there, and its counts are
#: so far from chance (log-likelihood ratio: a term among a hundred thousand gets there by chance once in hundreds).
MIN_TOXIC, MIN_LIFT, MIN_EVIDENCE = 6, 20.0, 28.0
BEGINNINGS = (4, 5, 6, 7, 8)

_WORDS = re.compile(r"[^\W\d_]+").findall
_MASKED = re.compile(r"\b\w\*{2,}\w?")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_SPELLED = re.compile(r"[a-z][013457@$]+[a-z]")
_LETTERS = str.maketrans("013457@$", "oieastas")
#: Words that address a reader.
ADDRESS = frozenset("you your u du dich dein ihr tu toi te vous vos ti eres".split())
PATTERNS = ("masked", "spelled", "addressed", "shouting", "exclaims", "many_terms", "dense_terms", "stray_term", "no_term")
#: Patterns that vote clean when they hold.
CALM = ("stray_term", "no_term")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Lexicon:
    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[str, int] = field(default_factory=dict)
    clean: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.keys = {t[:3] for t in [*self.words, *self.beginnings]}
        self.toxic = len(self.words) + len(self.beginnings)
        self.size = self.toxic + len(self.clean)

    def term(self, word: str) -> int:
        found = self.words.get(word, -1)
        if found < 0:
            for n in BEGINNINGS:
                found = self.beginnings.get(word[:n], -1)
                if found >= 0:
                    break
        return found

    def look(self, text: str) -> tuple[Counter, set[int], list[bool], int]:
        """(times of each toxic term, clean terms, pattern by pattern whether it holds, words) of a whole text.

        Clean terms are looked for only in texts without a toxic one.
        """
        low = text.lower()
        words = _WORDS(low)
        keys = self.keys
        near = [w for w in set(words) if w[:3] in keys]
        terms = {w: t for w in near if (t := self.term(w)) >= 0}
        hits: Counter = Counter()
        if terms:
            for w in words:
                if w in terms:
                    hits[terms[w]] += 1
        spelled = False
        if _SPELLED.search(low):
            spelled = any(
                self.term(w) >= 0 for t in low.split() if _SPELLED.search(t) for w in _WORDS(t.translate(_LETTERS))
            )
        addressed = bool(terms) and any(a in ADDRESS and b in terms for a, b in zip(words, words[1:]))
        n, total = len(words), sum(hits.values())
        masked = "**" in text and bool(_MASKED.search(low))
        marks = [
            masked, spelled, addressed,
            len(_SHOUT.findall(text)) * 5 > n > 0, "!!" in text, total >= 3, total * 100 > n > 0,
            total == 1 and n >= 100 and not masked and not spelled, not total and not spelled,
        ]
        calm = {self.clean[w] for w in set(words) if w in self.clean} if self.clean and marks[-1] else set()
        return hits, calm, marks, n

    def features(self, text: str) -> np.ndarray:
        """Term presence, and the pattern marks with the share of terms among words."""
        hits, calm, marks, _ = self.look(text)
        row = np.zeros(self.size + len(PATTERNS) + 1, np.float32)
        row[[*hits, *calm]] = 1
        row[self.size : -1] = marks
        row[-1] = math.log1p(sum(hits.values()))
        return row


def votes(features: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """1 toxic, -1 clean, 0 none: toxic terms and most patterns vote toxic when they hold, clean terms and ``CALM`` clean.

    A stray term does not vote for itself: the pattern votes in its place.
    """
    out = features[:, :-1].astype(np.int8)
    out[out[:, lexicon.size + PATTERNS.index("stray_term")] > 0, : lexicon.toxic] = 0
    out[:, lexicon.toxic : lexicon.size] *= -1
    out[:, [lexicon.size + PATTERNS.index(name) for name in CALM]] *= -1
    return out


def _logit(p):
    return np.log(p) - np.log1p(-p)


@dataclass
class LabelModel:
    """Class balance, accuracies and pair terms; a voter has one side, toxic (1) or clean (-1), or abstains."""

    prior: float
    base: float  # log odds of a row without votes; the prior odds, or what silence says besides
    side: np.ndarray
    accuracy: np.ndarray  # of each voter: chance that the class is its side where it votes
    pairs: np.ndarray  # (first, second) voter of each tree edge
    shared: np.ndarray  # of each edge: what both votes say less than the two by themselves, as log odds

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance of toxic given the votes.

        With a_j the accuracy of a voter, its vote multiplies the odds by P(vote | toxic) / P(vote | clean), which by
        Bayes is (a_j / (1 - a_j))^side over the prior odds; an edge whose ends both vote multiplies them by the
        ratio of P(both | class) / (P(one | class) P(other | class)) in the two classes.
        """
        fired = (v != 0).astype(float)
        total = self.base + fired @ (self.side * _logit(self.accuracy) - _logit(self.prior))
        if len(self.pairs):
            total = total + (fired[:, self.pairs[:, 0]] * fired[:, self.pairs[:, 1]]) @ self.shared
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _forest(strength: np.ndarray, least: float) -> np.ndarray:
    """Edges of the spanning forest of greatest strength, of those above ``least``."""
    m = len(strength)
    best, source = np.full(m, -np.inf), np.full(m, -1)
    open_ = np.ones(m, bool)
    edges = []
    for _ in range(m):
        k = int(np.argmax(np.where(open_, best, -np.inf))) if np.isfinite(best[open_]).any() else int(np.argmax(open_))
        open_[k] = False
        if source[k] >= 0:
            edges.append((source[k], k))
        nearer = open_ & (strength[k] > best) & (strength[k] > least)
        best[nearer], source[nearer] = strength[k][nearer], k
    return np.array(edges, int).reshape(-1, 2)


def _balance(odds: np.ndarray, prior: float) -> float:
    """The constant that brings the mean chance to ``prior``."""
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(middle + odds, -60, 60)))).mean() < prior:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """EM with a given class balance, from votes alone.

    A round weighs rows by their posteriors, finds accuracies, brings the posteriors' mean to the class balance, and takes the forest of the pairs whose votes tell most
    about each other within the classes (one side, likelihood ratio above ``MIN_EVIDENCE``).
    """
    lean = v.sum(1)
    p = np.where(lean > 0, 0.9, np.where(lean < 0, 0.02, prior))
    side = np.where(v.sum(0) >= 0, 1.0, -1.0)
    fired = (v != 0).astype(float)
    count = fired.sum(0)
    for _ in range(rounds):
        toxic = p @ fired
        rates = (count - toxic + PSEUDO) / ((1 - p).sum() + 2 * PSEUDO), (toxic + PSEUDO) / (p.sum() + 2 * PSEUDO)
        # accuracies at the given balance, whatever the posteriors' mean is: without it they could drift to one class
        right = prior * rates[1] / (prior * rates[1] + (1 - prior) * rates[0])
        accuracy = np.where(side > 0, right, 1 - right)
        evidence, lift = np.zeros((v.shape[1],) * 2), []
        for w in (1 - p, p):
            n = max(w.sum(), 1e-9)
            both = (fired * w[:, None]).T @ fired
            one = np.diag(both)
            chance = np.outer(one, one) / n
            cells = (
                (both, chance), (one[:, None] - both, one[:, None] - chance), (one[None] - both, one[None] - chance),
                (n - one[:, None] - one[None] + both, n - one[:, None] - one[None] + chance),
            )
            told = sum(seen * np.log((np.clip(seen, 0, None) + 1e-9) / (np.clip(due, 0, None) + 1e-9)) for seen, due in cells)
            evidence += np.where(both > chance, 2 * told, 0)
            rare, often = np.minimum.outer(one, one), np.maximum.outer(one, one) / n + 1e-9
            lift.append(np.log((both + PSEUDO * often) / (rare + PSEUDO) / often))
        evidence *= np.equal.outer(side, side)
        np.fill_diagonal(evidence, 0)
        pairs = _forest(evidence, MIN_EVIDENCE)
        shared = (lift[1] - lift[0])[pairs[:, 0], pairs[:, 1]]
        # what two votes share is at most what the weaker of them says
        ends = (side * _logit(accuracy) - _logit(prior))[pairs]
        most = np.where(ends[:, 0] * ends[:, 1] > 0, np.abs(ends).min(1), 0.0)
        shared = np.where(ends[:, 0] > 0, np.clip(shared, -most, 0), np.clip(shared, 0, most))
        model = LabelModel(prior, 0.0, side, accuracy, pairs, shared)
        model.base = _balance(_logit(np.clip(model.posterior(v), 1e-13, 1 - 1e-13)), prior)
        new = model.posterior(v)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, decay: float = 2e-5, rounds: int = 60) -> np.ndarray:
    """Logistic weights, the last the constant, for soft targets: Newton steps on the penalised likelihood."""
    full = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    weights = np.zeros(full.shape[1])
    penalty = decay * len(x) * np.eye(len(weights)) + 1e-6 * np.eye(len(weights))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (target - p) - penalty @ weights
        curve = (full * (p * (1 - p))[:, None]).T @ full + penalty
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None
    label_model: LabelModel | None = None

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        total = float(self.lexicon.features(text or "") @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _sample(docs: DataFrame, labels: DataFrame, limit: int, skip: Column | None) -> DataFrame:
    known = labels.where("toxic IS NOT NULL AND label_id IS NOT NULL")
    if skip is not None:
        known = known.where(~skip)
    known = known.groupBy("label_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    spread = F.xxhash64("label_id")
    toxic = known.where("toxic = 1").orderBy(spread, "label_id").limit(limit // 3)
    clean = known.where("toxic = 0").orderBy(spread, "label_id").limit(limit - limit // 3)
    chosen = F.broadcast(toxic.union(clean))
    # of rows that share an id the least text: one row a label, the same on every run
    found = docs.join(chosen, F.col("id") == F.col("label_id")).groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found.repartition(shuffle_width(docs), "id").select("text", "toxic")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings of toxic sample texts, and words of clean ones, by document counts in both classes."""

    def count(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = {w for w in _WORDS((text or "").lower()) if len(w) > 2}
                begun = {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}
                seen[toxic].update(words)
                seen[toxic].update(begun)
            terms = [*seen[1], *(t for t in seen[0] if t not in seen[1])]
            yield pd.DataFrame(
                {"term": terms, "bad": [seen[1][t] for t in terms], "good": [seen[0][t] for t in terms]}
            ).astype({"term": "str"})
            yield pd.DataFrame({"term": [""], "bad": [int(batch["toxic"].sum())], "good": [int((1 - batch["toxic"]).sum())]})

    counts = in_batches(sample, count, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    counts = written(counts, "terms")
    totals = counts.where("term = ''").first()
    if totals is None or not totals["bad"]:
        discard(counts)
        return Lexicon()
    bad, good = totals["bad"], totals["good"]
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    both, share = F.col("bad") + F.col("good"), bad / (bad + good)
    evidence = 2 * (
        F.col("bad") * F.log(F.col("bad") / (both * share))
        + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0)
    )
    calm_evidence = 2 * (
        F.col("good") * F.log(F.col("good") / (both * (1 - share)))
        + F.when(F.col("bad") > 0, F.col("bad") * F.log(F.col("bad") / (both * share))).otherwise(0)
    )
    best = (
        counts.where((F.col("term") != "") & (F.col("bad") >= MIN_TOXIC) & (lift >= MIN_LIFT))
        .withColumn("evidence", evidence)
        .where(F.col("evidence") >= MIN_EVIDENCE)
        .orderBy(F.desc("evidence"), F.col("term").startswith("^"), F.length("term"), "term")
        .limit(8 * MAX_TERMS)
        .collect()
    )
    words: list[str] = []
    begun: list[str] = []
    support: dict[str, int] = {}
    for row in best:
        plain = row["term"].lstrip("^")
        inner = max((n for t, n in support.items() if t.startswith(plain)), default=0)
        if any(plain.startswith(b) for b in begun) or inner * 10 >= row["bad"] * 9:
            continue  # a chosen beginning covers it, or one chosen term makes up most of it
        if len(support) >= MAX_TERMS:
            break
        support[plain] = row["bad"]
        (begun if row["term"].startswith("^") else words).append(plain)
    calm = (
        counts.where(~F.col("term").startswith("^") & (F.col("term") != "") & (F.col("good") >= MIN_TOXIC) & (lift * MIN_LIFT <= 1))
        .withColumn("evidence", calm_evidence)
        .where(F.col("evidence") >= MIN_EVIDENCE)
        .orderBy(F.desc("evidence"), "term")
        .limit(MAX_TERMS)
        .collect()
    )
    discard(counts)
    terms = len(words) + len(begun)
    return Lexicon(
        {w: i for i, w in enumerate(words)},
        {b: len(words) + i for i, b in enumerate(begun)},
        {row["term"]: terms + i for i, row in enumerate(calm)},
    )


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, doc_id="doc_id", text="text",
          label_id="doc_id", toxic="toxic", skip_held_out: bool = True) -> Model:
    """Lexicon, label model and classifier. Without toxic terms every score is 0; of rows that share an id one is learnt from."""
    known = pick(labels, label_id, toxic).toDF("label_id", "toxic")
    rows = pick(docs, doc_id, text).toDF("id", "text")
    sample = written(_sample(rows, known, limit, held_out(F.col("label_id")) if skip_held_out else None), "toxic")
    lexicon = learn_lexicon(sample)
    if not lexicon.toxic:
        discard(sample)
        return Model(lexicon, None)

    def rows_of(batches):
        for batch in batches:
            found = [lexicon.features(t or "") for t in batch["text"]]
            yield pd.DataFrame({"x": [r.tobytes() for r in found], "toxic": batch["toxic"].astype("int32")})

    found = in_batches(sample, rows_of, "x binary, toxic int").toPandas().sort_values(["x", "toxic"])
    discard(sample)
    x, label = np.frombuffer(b"".join(found["x"]), np.float32).reshape(len(found), -1), found["toxic"].to_numpy()
    v = votes(x, lexicon)
    model = fit_label_model(v, min(max(label.mean(), 0.01), 0.99))
    return Model(lexicon, fit_linear(x, model.posterior(v)), model)


def score_documents(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null texts score as empty ones. Repeated rows are scored each by itself, a score of just 0.5 counts as
    toxic, an empty table gives no rows, other columns are left behind.
    """

    def work(batches):
        for batch in batches:
            score = np.array([model.score(t) for t in batch[text]], float)
            out = pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32")})
            for i, name in enumerate(("doc_id", "held_out")):
                out.insert(i, name, batch[name].to_numpy())
            yield out

    rows = pick(docs, doc_id, text)
    rows = rows.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias(text))
    return with_ids(rows, "doc_id", work, "doc_id", "held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text="text", most: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``most`` or more; columns as they are."""
    place = docs.columns.index(text)
    schema = docs.schema

    def work(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([model.score(t) < most for t in texts], pa.bool_()))

    return in_batches(docs, work, schema, arrow=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
