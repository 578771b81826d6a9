"""Each operator on small tables: against brute force, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splitlab.llm import (
    bpe, components, cross_polytope, html_text, line_labels, mixing, order_minhash, packing, pii, rans, toxicity,
)

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, node string, rank_ int, size_ int"


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(i, text_of(rng, rng.randint(1, 80)), "en", f"s{i % 3}") for i in range(60)]
    made += [(60, None, None, None), (61, "", "en", "s1"), (62, " \n ", "en", None), (None, "no id here", "en", "s2"), ((1 << 60) + 1, "far", "en", "s1")]
    made += [(63, made[5][1], "de", "s0"), made[7], made[7], (64, text_of(rng, 4000), "en", "s4")]
    return [(*r, None, "other", "n", 1, 2) for r in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.id: r.root for r in found.collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked if top(x) != x}


def test_mix(spark, docs, none, rows):
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    plain = mixed.toDF(*[f"c{i}" for i in range(len(mixed.columns))]).collect()
    n = len(docs.columns)
    assert len(plain) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(3 * size[s] for s in capped)) / left if left else 0
        more = {s for s in names if s not in capped and 3 * size[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * size[s] if s in capped else level * weight[s] for s in names}
    taken = defaultdict(int)
    for r in plain:
        assert r[n] == len((r[1] or "").split()) and r[n + 1] == size[r[3]]
        assert r[n + 2] == pytest.approx(target[r[3]]) and 0 <= r[n + 3] <= 3
        taken[r[3]] += r[n] * r[n + 3]
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(len((r[1] or "").split()) for r in rows if r[3] == s)
    again = mixing.mix(docs.repartition(7))
    key = lambda df: sorted(map(str, df.toDF(*[f"c{i}" for i in range(n + 4)]).collect()))
    assert key(again) == key(mixed)
    out = mixing.emit(mixed)
    assert out.columns == [c for c in docs.columns if c != "size_"] or len(out.columns) == len(docs.columns)
    assert out.count() == sum(r[n + 3] for r in plain)
    assert mixing.mix(none).count() == 0


def test_token_digests(docs, none, rows):
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    want = []
    for r in rows:
        text = r[1] or ""
        ids = known.encode_ordinary(text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((r[0], len(ids), *sha))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.digest_documents(docs).collect())
    full = bpe.encode_documents(docs).collect()
    assert sorted(r.decoded for r in full) == sorted(r[1] or "" for r in rows)
    assert bpe.digest_documents(none).count() == 0


def test_token_files(docs, none, rows):
    segments = rans.write_tokens(docs)
    found = rans.read_tokens(segments, ids=True).collect()
    tool = rans.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in rows:
        ids = tool.tool.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0]].append((len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()), ids))
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32, r.ids))
    assert not any(want.values())
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert rans.read_tokens(rans.write_tokens(none)).count() == 0


def test_token_files_hold_added_tokens(spark):
    made = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "a <|endoftext b")]
    found = rans.read_tokens(rans.write_tokens(spark.createDataFrame(made, "doc_id long, text string")), ids=True).collect()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.ids for r in found} == {i: tool.encode(t, add_special_tokens=False).ids + [2] for i, t in made}


def test_packing(docs, none, rows):
    out = packing.slots(packing.assign(docs, shards=5))
    n = len(docs.columns)
    found = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
    assert len(found) == len(rows)
    place, bins, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in found:
        data = (r[1] or "").encode()
        assert r[n] == len(data) + 16 and r[n + 1] == zlib.crc32(data)
        place[r[1] or ""].add(r[n + 2])
        bins[r[n + 2]].append(r[n + 3])
        sizes[r[n + 2]] += r[n]
    assert all(len(s) == 1 for s in place.values()) and len(bins) == 5
    assert all(sorted(s) == list(range(len(s))) for s in bins.values())
    rest = sorted(sizes.values())[:-1]  # the long text alone is more than a fifth
    assert max(rest) - min(rest) < 0.05 * max(rest)
    assert packing.slots(packing.assign(none)).count() == 0


def test_line_labels(spark, docs, none, rows):
    rng = random.Random(2)
    good = [(i, "\n".join(text_of(rng, 12) for _ in range(8)), 1) for i in range(60)]
    bad = [(100 + i, "\n".join(" | ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(8)), 0) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = line_labels.train(table, table)
    out = {r.doc_id: r for r in line_labels.label_documents(table, model).collect()}
    assert all(out[i].kept == bool(q) for i, _, q in good + bad)
    found = line_labels.label_documents(docs, None).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.kept == (not r.base_failed)
        if r.doc_id in (60, 61, 62):
            assert (r.n_words, r.word_chars, r.n_dup_lines, r.base_failed) == (0, 0, 0, True)
    odd = spark.createDataFrame([(1, "a b c\nx\na b c\n\n\nx | #\nx")], "doc_id long, text string")
    r = line_labels.label_documents(odd, None).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (11, 11, 2, 2, 8)
    assert line_labels.train(docs, table.where("quality = 1")) is None
    assert line_labels.train(none, table) is None and line_labels.label_documents(none, model).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    made = []
    for i in range(500):
        words = text_of(rng, 30).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, 30), rng.choice(["vilest", "rotter", "grimoax", "grimoen", "grimout"]))
        made.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table)
    assert "vilest" in model.lexicon.words and any(b.startswith("grim") for b in model.lexicon.beginnings)
    out = toxicity.score_documents(table, model).collect()
    truth = {i: t for i, _, t in made}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in out if r.held_out) == sum(r.held_out for r in out)
    assert toxicity.reject(table, model).count() == 400
    again = table.union(table.selectExpr("doc_id", "concat(text, ' zz') AS text", "toxic"))
    models = [toxicity.train(again.repartition(n), table) for n in (1, 7)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].lexicon == models[1].lexicon
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    plain = toxicity.train(table, table.where("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(table, plain).collect()} == {0.0}
    assert toxicity.score_documents(none, model).count() == 0


def test_personal_data(spark, docs, none):
    rng = random.Random(6)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    kinds = [
        lambda: f"bo{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ]
    made = [(i, f"aa {rng.choice(kinds)()} bb {rng.choice(['CC 4.0.', 'id 77', 'x2y3', 'no'])} cc") for i in range(400)]
    two = [(1000 + i, f"aa {kinds[3]()} {card()} bb {kinds[1]()} {kinds[0]()}") for i in range(20)]
    table = spark.createDataFrame(made + two, "doc_id long, text string")
    model = pii.train(table)
    for i, text in two:
        base, spans = pii.find(text, model)
        assert [k for _, k, _ in spans] == [3, 2, 1, 0], (text, spans)
        assert set(base) <= set(spans) and pii.masked(text, model) == "aa <PHONE> <CARD> bb <IP> <EMAIL>"
    out = {r.doc_id: r for r in pii.find_documents(table, model).collect()}
    for i, text in made:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and out[i].spans == base
    found = {r.doc_id: r for r in pii.find_documents(docs, model).collect()}
    assert found[60].spans == "" and found[61].n_email == 0
    untrained = pii.train(none)
    assert pii.find("call 1234567890123", untrained)[1] == [] and pii.find_documents(none, untrained).count() == 0


def brute_classes(rows):
    texts = sorted({r[1] or "" for r in rows})
    block = order_minhash.TextBlock(texts)
    doc, value = order_minhash.shingles(block)
    seq = [value[doc == i] for i in range(len(texts))]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(seq[i]) and len(seq[j]) and order_minhash.similarity(seq[i], seq[j]) >= 0.8:
                up[top(i)] = top(j)
    place = {t: top(i) for i, t in enumerate(texts)}
    least = {}
    for r in rows:
        if r[0] is not None:
            k = place[r[1] or ""]
            least[k] = min(least.get(k, r[0]), r[0])
    return {(r[0], r[1]): least.get(place[r[1] or ""]) for r in rows}


def test_near_classes(spark, docs, none, rows):
    rng = random.Random(9)
    made = [(r[0], r[1]) for r in rows]
    for family in range(3):  # chains: every text differs a little from the one before
        words = text_of(rng, 120).split()
        for step in range(40):
            words[rng.randrange(120)] = rng.choice(WORDS)
            made.append((1000 + 100 * family + step, " ".join(words)))
    shared = text_of(rng, 60)
    made += [(2000 + i, shared + " " + text_of(rng, 25)) for i in range(40)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    want = brute_classes(made)
    got = {(r.id, r.text): r.class_id for r in order_minhash.near_classes(table).join(
        table.select(F.col("doc_id").alias("d"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("m")),
        (F.col("m") == F.col("node")) & F.col("id").eqNullSafe(F.col("d"))).collect()}
    assert got == want
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    single = brute_classes(rows)
    assert kept.count() == len(set(single.values()))
    assert order_minhash.near_classes(none).count() == 0


def test_one_of_each_keeps_texts_whose_ids_are_equal(spark):
    rng = random.Random(21)
    a, b, c, d, e, near = (text_of(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (5, c), (5, d), (7, e), (7, e), (9, near), (9, near + " end"), (None, near + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame([r for r in rows if r[0] != 7], "doc_id long, text string")
    kept, other = ([tuple(r) for r in order_minhash.one_of_each(t).collect()] for t in (table, once))
    assert len(kept) == 6 and set(kept) - {(9, near), (9, near + " end")} == {(None, a), (None, b), (5, c), (5, d), (7, e)}
    assert set(other) == set(kept) - {(7, e)} and len(other) == 5


def test_cells_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PART", 5)
    rng = random.Random(10)
    base = text_of(rng, 60).split()
    made = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        made.append((i, " ".join(words)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    want = brute_classes(made)
    assert {r.id: r.class_id for r in order_minhash.near_classes(table).collect()} == {i: c for (i, _), c in want.items()}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 20))
    made = []
    for i in range(300):
        c = centres[i % 30]
        v = c if i % 7 == 0 else c + 0.1 * rng.normal(size=20)
        made.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    bad = [None, [], [0.0] * 20, [float("nan")] * 20, [1.0, None] + [0.0] * 18, [float("inf")] * 20]
    made += [(400 + i, v, 1) for i, v in enumerate(bad)] + [(500, made[0][1], None), (None, made[1][1], 1), (501, [1.0], 0), made[3]]
    table = spark.createDataFrame([(*r, "x") for r in made], "vec_id long, embedding array<float>, label int, node string")
    good = [k for k, (_, v, y) in enumerate(made) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    up = list(range(len(made)))
    n = [0] * len(made)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in good:
        for b in good:
            x, y = np.array(made[a][1]), np.array(made[b][1])
            if a < b and made[a][2] == made[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                up[top(b)] = top(a)
    out = cross_polytope.link_embeddings(table).collect()
    assert len(out) == len(made)
    found = sum(r.n_links for r in out)
    assert found <= sum(n) and found >= 0.97 * sum(n)
    by = {r.vec_id: r for r in out}
    for k, (i, *_) in enumerate(made):
        if k not in good:
            assert by[i].n_links == 0 and by[i].component_id == i and by[i].kept
        assert by[i].n_links <= n[k] and (i is None or by[i].kept == (by[i].component_id == i))
    assert cross_polytope.link_embeddings(table.where("vec_id < 0")).count() == 0


def test_page_texts(spark):
    made = [(1, "u", "<p>a<p>b", "t"), (2, None, None, None), (None, "u", "", "t"), (1, "u", "<p>a<p>b", "t")]
    table = spark.createDataFrame(made, "page_id long, url string, html string, text string")
    out = sorted(str(tuple(r)) for r in html_text.extract(table).collect())
    assert out == sorted(map(str, [(1, "a\n\nb"), (1, "a\n\nb"), (2, ""), (None, "")]))
    assert html_text.extract(table.limit(0)).count() == 0
