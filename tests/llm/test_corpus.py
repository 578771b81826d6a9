"""Aligned tokenizers, benchmark decontamination and collocations: against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splitlab.llm import alignment, decontaminate, phrases
from splitlab.session import written

SCHEMA = "doc_id long, text string, lang string, source string, TEXT string, row_ int, window string, a string, key long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa the of".split()


def rows_of(texts):
    return [(i, t, lang, None, "other", 1, "w", "x", 2) for i, (t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# benchmark decontamination

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "Short item, four words"),
    (3, "two three four five six seven eight nine ten ELEVEN!"),
    (4, None), (5, ""), (6, " ,.; "), (None, "item without id"), (7, "Short item four words"), (8, "Éa déjà vu"),
]
HIT = "One, two; three four five six seven eight nine ten"


def plain_marks(texts, items, size=10):
    def words(text):
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)

    windows = {}
    for key, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if key is None else str(key))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, size + 1):
                named = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if named:
                    hit |= set(range(i, i + n))
                    found |= named
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def dirty():
    rng = random.Random(4)
    texts = [None, "", " \n\t ", HIT, HIT.upper() + " eleven twelve", "x" + HIT, "short item four words " * 3, "éa déjà vu", "Éa déjà vu", "a"]
    texts += ["item without id item without id", HIT[:-4], "four five", "ten " * 30 + HIT + "\n" + HIT]
    texts += [" ".join(rng.choice(["short", "item", "four", "words", "one"]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return texts + [HIT, HIT, " ".join(["filler"] * 50_000) + " " + HIT]


@pytest.mark.parametrize("set_bytes", [1 << 20, 300])
def test_marks_equal_brute_force(spark, benchmark, set_bytes):
    texts = dirty()
    docs = spark.createDataFrame(rows_of([(t, "en") for t in texts]), SCHEMA).repartition(3)
    found = decontaminate.mark(docs, benchmark, set_bytes=set_bytes)
    assert found.columns[:9] == docs.columns
    got = {r[0]: (r[9], r[10], r[12]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == plain_marks(texts, ITEMS)


def test_clean_documents_and_cut_spans(spark, benchmark):
    texts = dirty()
    docs = spark.createDataFrame(rows_of([(t, "en") for t in texts]), SCHEMA)
    marked = decontaminate.mark(docs, benchmark)
    want = plain_marks(texts, ITEMS)
    kept = decontaminate.clean_documents(marked)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[1]}
    cut = {r[0]: r[1] for r in decontaminate.without_spans(marked).collect()}
    assert all(cut[i] == t for i, (t, w) in enumerate(zip(texts, want)) if not w[1])
    assert cut[5] == "xOne, two; three four five six seven eight nine ten"
    assert cut[4] == "TWELVE".lower() and cut[6] == "" and cut[13].split() == ["ten"] * 30
    left = decontaminate.mark(spark.createDataFrame(rows_of([(cut[i], "en") for i in range(len(texts))]), SCHEMA), benchmark)
    assert left.where("n_hit_ > 0").count() == 0


def test_decontamination_without_rows(spark, none, benchmark):
    assert decontaminate.mark(none, benchmark).count() == 0
    docs = spark.createDataFrame(rows_of([(HIT, "en"), (None, None)]), SCHEMA)
    found = decontaminate.mark(docs, benchmark.where("false")).select("n_words_", "n_hit_", "items_").collect()
    assert sorted(tuple(r) for r in found) == [(0, 0, []), (10, 0, [])]


# collocations


def plain_collocations(texts, least, longest, top):
    counts, total = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    many = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    covered = set()
    for (lang, w), n in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if n >= counts[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in many.items():
        if (lang, w) in covered:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        row = (" ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], total[lang], score)
        out.setdefault(lang, []).append(row)
    found = set()
    for lang, rows in out.items():
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        found |= {(lang, i + 1, *r) for i, r in enumerate(rows[:top])}
    return found


def chatter():
    rng = random.Random(9)
    made = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["alpha beta gamma delta eps zeta", rng.choice(WORDS), "The the the", "of\tthe", "é à"]))
            parts.append(rng.choice([" ", " ", "  ", ", ", ".\n", "\x0b", " \x1c "]))
        made.append(("".join(parts), ["en", "de", None, "und"][i % 4]))
    return made + [(None, "en"), ("", None), (" .,\n", "fr"), made[3], made[3], ("alpha beta " * 9000, "xx"), ("one" * 9000, "xx")]


@pytest.mark.parametrize("held, mass", [(3_000_000, 8_000_000), (500, 2_000)])
def test_collocations_equal_brute_force(spark, monkeypatch, held, mass):
    texts = chatter()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least=12, top=20, partition_mass=mass).collect()}
    assert got == plain_collocations(texts, 12, 5, 20)


def test_parts_meet_whole_whatever_the_join(spark):
    """Joins planned by shuffle and turned into broadcasts at run time must not split a part among summaries."""
    rows = []
    for run in range(10):  # each run holds every part's first key 12 times
        for part in range(8):
            start = 1000 * (run * 8 + part + 1)
            keys, counts = np.array([part, *range(start, start + 40)], np.uint64), np.array([12] + [1] * 40, np.int64)
            rows.append((part, int(counts.sum()), keys.tobytes(), counts.tobytes()))
    schema = "part int, mass long, keys binary, counts binary"
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "20000",  # above the masses, below the runs
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        packed = written(spark.createDataFrame(spark.sparkContext.parallelize(rows, 10), schema), "runs")
        assert sorted(r[0] for r in phrases.possible_keys(packed, 8, 100).collect()) == list(range(8))
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_collocations_without_rows(spark, none):
    assert phrases.collocations(none).count() == 0
    docs = spark.createDataFrame(rows_of([(None, None), ("  .", "en")]), SCHEMA)
    assert phrases.collocations(docs, least=1).count() == 0


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(5)
    for least in (5, 40):
        keys = np.concatenate([rng.zipf(1.2, 4000) % 900, np.arange(5000, 9000)]).astype(np.uint64)
        rng.shuffle(keys)
        true = Counter(keys.tolist())
        parts = [phrases.Summary(len(keys) // least + 1) for _ in range(4)]
        for i, chunk in enumerate(np.array_split(keys, 40)):
            summary = parts[i % 4]
            summary.add(*phrases._added(chunk, np.ones(len(chunk), np.int64)))
            summary.settle()
        first = parts[0]
        for other in parts[1:]:
            first.merge(other)
        left = set(first.possible(least).tolist())
        assert {k for k, n in true.items() if n >= least} <= left
        assert len(first.keys) <= first.capacity and first.lost * (first.capacity + 1) <= len(keys)
        assert all(n <= true[k] <= n + first.lost for k, n in zip(first.keys.tolist(), first.counts.tolist()))


def test_word_keys_are_sparks(spark):
    words = phrases.Words("de")
    # A to Z alone are made small
    assert words.read(["Größe, größe Ä ä".encode()]).tolist() == [1, 0, 1, 2, 3, 0]
    row = spark.createDataFrame([("de", "größe")], "l string, w string").select(F.xxhash64("l", "w")).first()[0]
    assert words.hashes[words["größe".encode()]] == row % (1 << 64)


# aligned tokenizers

ODD = [
    None, "", " ", "  two  spaces ", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "▁ sign", "tab\tand\nline\r\n", "日本語 émoji 🙂 x",
    "the the the", "\x00 zero", "é combining", "ﬁ ligature ½ Å", " nbsp", "x" * 3000,
]


def plain_alignment(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bytes_a = alignment.byte_spelling(public_tokenizers.path("byte_bpe_50k.json"))

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    made, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = first.encode(want.decode(), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if not text or b"".join(bytes_a[i] for i in a) != want or b"".join(map(bytes_b, b)) != want:
            made.append(None)
            continue
        ranges = [np.cumsum([0, *[len(x) for x in xs]]) for xs in (map(bytes_a.get, a), map(bytes_b, b))]
        links = [
            (a[i], b[j]) for i in range(len(a)) for j in range(len(b))
            if ranges[0][i] < ranges[1][j + 1] and ranges[1][j] < ranges[0][i + 1]
        ] if len(a) < 300 else None
        common = sorted(set(ranges[0]) & set(ranges[1]))
        groups = []
        for low, high in zip(common[:-1], common[1:]):
            side = [[xs[k] for k in range(len(xs)) if low <= r[k] < high] for xs, r in ((a, ranges[0]), (b, ranges[1]))]
            groups.append("|".join(",".join(map(str, s)) for s in side))
        made.append((len(a), len(b), groups, links))
        counts.update(links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for row in made:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        tops = sum(counts[k] == best[k[1]] for k in links)
        out.append((n_a, n_b, len(groups), len(links), tops, sum(counts[k] for k in links), digest))
    return out


@pytest.fixture(scope="module")
def aligned(spark):
    rng = random.Random(8)
    texts = [t if t is None else t[:250] for t in ODD] + ["".join(rng.choice("aet hn.é日") for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts += [texts[-1], texts[-1], "Some words, then more words."]
    docs = spark.createDataFrame(rows_of([(t, "en") for t in texts]), SCHEMA).repartition(3)
    stored = alignment.tokens(docs)
    return texts, stored, alignment.pair_counts(stored)


@pytest.mark.parametrize("table_pairs", [alignment.TABLE_PAIRS, 3])
def test_alignment_equals_brute_force(aligned, table_pairs):
    texts, stored, counts = aligned
    got = {r[0]: tuple(r)[1:] for r in alignment.digests(stored, counts, table_pairs=table_pairs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_groups_spell_the_text(aligned):
    texts, stored, _ = aligned
    spelled = alignment.byte_spelling(public_tokenizers.path("byte_bpe_50k.json"))
    for key, groups in alignment.groups(stored).collect():
        said = b"".join(spelled[i] for g in groups for i in g["a"])
        assert not groups or said == (" " + texts[key]).encode()


def test_alignment_of_no_rows_and_null_ids(spark, none):
    stored = alignment.tokens(none)
    assert alignment.digests(stored, alignment.pair_counts(stored)).count() == 0
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, None)], "doc_id long, text string")
    stored = alignment.tokens(docs)
    for table_pairs in (100, 0):
        rows = alignment.digests(stored, alignment.pair_counts(stored), table_pairs=table_pairs).collect()
        assert sorted((r.doc_id is None, r.n_a > 0) for r in rows) == [(False, False), (True, True), (True, True)]


# long texts and samples of the other operators


def test_pii_takes_time_in_proportion_to_a_text():
    from splitlab.llm import pii

    model = pii.Model(np.zeros((len(pii.FEATURES), len(pii.KINDS))), np.zeros((len(pii.KINDS) + 1, len(pii.KINDS) + 1)))
    line = "10.20.30.40\n"
    base, spans = pii.find(line * 60_000, model)
    assert len(base) == 60_000 and set(base) <= set(spans)


def test_line_model_does_not_depend_on_partitions_and_is_bounded(spark):
    from splitlab.llm import line_labels

    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) for _ in range(20)) for _ in range(60)]
    docs = spark.createDataFrame([(i % 12, t) for i, t in enumerate(texts)] + [(3, "x\n" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    models = [line_labels.train(docs.repartition(n), labels, limit=40, most_lines=900) for n in (1, 3, 7)]
    assert all(np.allclose(models[0].weights, m.weights) and np.allclose(models[0].turns, m.turns) for m in models[1:])


def plain_tree(page):
    """The tree by walking the stack for every tag: (tag, children) of its elements and texts."""
    from splitlab.llm import html_text as h

    root = ["html", []]
    stack = [root]
    for event in h.scan(page):
        if event[0] == "text":
            stack[-1][1].append(event[1])
        elif event[0] == "open":
            tag = event[1]
            ends, walls = h.CLOSES.get(tag, ((), ()))
            i = len(stack) - 1
            while i > 0:
                if stack[i][0] in ends:
                    del stack[i:]
                    if tag not in ("tr", "thead", "tbody", "tfoot", "optgroup", "li", "dt", "dd"):
                        break
                elif stack[i][0] in walls:
                    break
                i -= 1
            element = [tag, []]
            stack[-1][1].append(element)
            if tag not in h.VOID:
                stack.append(element)
        elif event[1] == "p" and not any(e[0] == "p" for e in stack):
            stack[-1][1].append(["p", []])
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == event[1]:
                    del stack[i:]
                    break
                if stack[i][0] in h._WALLS and event[1] not in h._TABLE_ENDS:
                    break
    return root


def test_tree_equals_a_walk_of_the_stack():
    from splitlab.llm import html_text as h

    def shape(element):
        return [element.tag, [c if isinstance(c, str) else shape(c) for c in element.children]]

    rng = random.Random(12)
    tags = "p div button table tr td th caption thead tbody ul li dl dt dd select option optgroup span b".split()
    for _ in range(400):
        page = "".join(rng.choice([f"<{t}>", f"</{t}>", f"<{t}>x"]) for t in rng.choices(tags, k=rng.randint(1, 60)))
        assert shape(h.build(page)) == plain_tree(page)


def test_deep_pages_take_time_in_proportion():
    from splitlab.llm import html_text as h

    assert len(h.build("<p><button>" + "<div>" * 100_000 + "x").children) == 1
    assert len(h.build("<td>" + "<b>" * 100_000 + "</i></p></div>" * 50_000).children) == 1


def test_the_last_declaration_shows_or_hides():
    from splitlab.llm import html_text as h

    page = '<p style="display:none;display:block">seen</p><p style="Display: block; display:NONE">not</p>'
    assert h.page_text(page).split() == ["seen"]
