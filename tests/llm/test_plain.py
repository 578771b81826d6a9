"""The operators' inner methods against definitions, without Spark."""

import itertools
import math
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from splitlab.llm import bpe, cross_polytope, html_text, line_labels, order_minhash, packing, pii, rans, toxicity
from splitlab.llm.textblock import TextBlock, blocks, windows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def noise(seed, n, most=25):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "漢", "😀", "1", "'s", "the", "ing", "  ", "\r", "\0", "𝒜"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_transducer_equals_the_library(codec):
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={}
    )
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in [*noise(1, 2000), *words, "a" * 9000, "ab" * 5000, "é" * 3000, " " * 5000 + "x"]:
        ids = codec.encode(text)
        assert ids == known.encode_ordinary(text)
        assert "".join(codec.decode(ids)) == text


def test_machine_that_starts_anew_gives_the_same():
    ranks = bpe.load_ranks(PATH)
    small, large = bpe.Transducer(ranks, max_states=5), bpe.Transducer(ranks)
    for word in noise(3, 200):
        assert small.run(word.encode()) == large.run(word.encode())


def test_stream_holds_back_split_characters():
    text = "aé漢😀z"
    for size in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        data = text.encode()
        out = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join([*out, stream.close()]) == text
    broken = bpe.Utf8Stream("replace")
    assert broken.feed(b"a\xe6") == "a" and broken.close() == "�"


def test_text_block_words():
    texts = ["one two\none", "", " \n ", "x", "é  漢\x0bb c d e"]
    block = TextBlock(texts)
    found = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert block.words_of().tolist() == [len(f) for f in found]
    flat, hashes = [w for f in found for w in f], block.word_hashes()
    assert len(set(hashes.tolist())) == len(set(flat))
    assert hashes[0] == hashes[2]
    assert len(windows(hashes, block.word_doc, 3)[0]) == 1 + 4
    assert list(blocks([])) == [] and list(blocks(["a", None, "b"])) == [(0, 3)]


def test_viterbi_equals_all_labelings():
    rng = np.random.default_rng(3)
    doc = np.repeat([2, 5, 6], [4, 1, 6])
    scores, turns = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    found = line_labels.viterbi(scores, turns, doc)
    for d in (2, 5, 6):
        at = np.flatnonzero(doc == d)
        best = max(
            itertools.product((0, 1), repeat=len(at)),
            key=lambda y: sum(scores[i, v] for i, v in zip(at, y)) + sum(turns[a, b] for a, b in zip(y, y[1:])),
        )
        assert found[at].tolist() == list(best)


def test_chain_fit_separates_lines():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 200).repeat(3)
    x = np.stack([np.ones(600), label ^ (rng.random(600) < 0.05)], 1).astype(bool)
    model = line_labels.fit(x, label, np.arange(200).repeat(3))
    found = line_labels.viterbi(x @ model.weights, model.turns, np.arange(200).repeat(3))
    assert (found == label).mean() > 0.98


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, x=x, row=row: row[j - 1] + 1 if x == b[j - 1] else max(left, row[j]), initial=0))
    return row[-1]


def test_alignment_equals_the_table(monkeypatch):
    rng = np.random.default_rng(4)
    for rows in (2048, 7):
        monkeypatch.setattr(order_minhash, "_BLOCK_ROWS", rows)
        for _ in range(150):
            a = rng.integers(0, 9, rng.integers(1, 40)).astype(np.uint32)
            b = np.array([v for v in a if rng.random() > 0.1] or [1], np.uint32)
            b = np.insert(b, rng.integers(0, len(b) + 1, 2), 3).astype(np.uint32)
            full, true = len(a) + len(b), lcs(a.tolist(), b.tolist())
            assert order_minhash.aligned(a, b, full) == true
            need = full - 2 * true
            assert order_minhash.aligned(a, b, need) == true
            assert order_minhash._common(a, b) >= true


def test_similarity_knows_order():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.similarity(a, a) == 1
    assert order_minhash.similarity(a, np.roll(a, 50)) == 0
    assert order_minhash.similarity(a, a[11:]) == pytest.approx(89 / 100)
    assert order_minhash.similarity(a[:0], a[:0]) == 1 and order_minhash.similarity(a, a[:0]) == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = cross_polytope.hadamard(x.copy())
    assert np.allclose((y**2).sum(1), 16 * (x**2).sum(1))
    assert np.allclose(cross_polytope.hadamard(y), 16 * x)


def test_segments_round_trip_and_notice_damage():
    rng = np.random.default_rng(2)
    ids = [np.append(rng.zipf(1.3, rng.integers(0, 900)) % 50_000, 2).astype(np.uint32) for _ in range(600)]
    payload = rans.encode_segment([None, *range(599)], ids)
    segment = rans.Segment(payload)
    whole = np.concatenate(ids)
    assert (segment.all() == whole).all() and segment.lengths.tolist() == [len(x) for x in ids]
    assert segment.missing[0] and not segment.missing[1:].any()
    k = len(segment.points) - 1
    _, first, tokens, _ = segment.points[k]
    assert k > 0 and (segment.block(k) == whole[first : first + tokens]).all()
    broken = bytearray(payload)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.Segment(bytes(broken)).all()
    for odd in (np.array([2]), np.arange(60_000), np.full(3000, 7)):
        odd = odd.astype(np.uint32)
        assert (rans.Segment(rans.encode_segment([1], [odd])).all() == odd).all()


def test_chunked_encoder_equals_the_library():
    tool = rans.Encoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50)
    for text in noise(9, 1500, 20):
        known = tool.tool.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.encode(text), np.uint32).tolist() == known, repr(text)


def test_encoder_matches_added_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh, tool = Tokenizer.from_file(path), rans.Encoder(path, limit=50)
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "<", " ", "  ", "a", "\n", "é", "'s", "1"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for text in ["a <|endoftext|> b", "<|endoftext|>", "a  <|endoftext|>  b", *made, *noise(13, 200)]:
        known = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.encode(text), np.uint32).tolist() == known, repr(text)
    assert np.frombuffer(tool.encode("a <|endoftext|> b"), np.uint32).tolist() == [64, 220, 50256, 275]


def test_encoder_holds_a_plain_word_once():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(3000)]
    tool = rans.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode("x " + " ".join(words))
    assert len(tool.chunks) + len(tool.pieces) < 3100


def test_transducer_takes_known_steps_without_a_call_a_byte():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tool = bpe.Transducer(ranks)
    data, calls = b" tionhaerreingst", []
    want = tool.run(data)
    sys.setprofile(lambda frame, event, what: calls.append(event))
    try:
        found = tool.run(data)
    finally:
        sys.setprofile(None)
    assert found == want == bpe.merge(ranks, data)
    assert len(calls) < 2 * len(data)


def test_best_fit_equals_a_search_through_all_bins():
    rng = random.Random(7)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 200))), reverse=True)
        free, want = [], []
        for size in sizes:
            fits = [(f, i) for i, f in enumerate(free) if f >= size]
            i = min(fits)[1] if fits else len(free)
            if not fits:
                free.append(120)
            free[i] -= size
            want.append(i)
        assert packing.best_fit(sizes, 120) == want
    assert packing.best_fit([200, 5], 120) == [0, 1]
    assert packing.pack([], 4) == [] and len(set(packing.pack([9, 1, 1, 1], 2))) == 2


def test_tree_stays_balanced():
    tree = packing.FreeSpace()
    for i in range(2000):
        tree.insert((i, i))

    def depth(node):
        return 1 + max(depth(node.left), depth(node.right)) if node else 0

    assert depth(tree.root) <= 2 * math.log2(2000) + 2
    for i in range(0, 2000, 2):
        tree.remove((i, i))
    assert tree.tightest(10) == (11, 11) and tree.tightest(1999) == (1999, 1999) and tree.tightest(2001) is None


RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(pii.digits_of(t)) <= 19 and pii.luhn(pii.digits_of(t))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(pii.digits_of(t)) <= 15),
)


def test_base_spans_equal_the_rules():
    rng = random.Random(11)
    parts = ["a.b", "@", "x-y.org", ".", "+1", " (", ") ", "555-1234", "4111111111111111", " ", "10.0.0.1", "é", "256", "-", "00", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = sorted(
            (m.start(), k, m.end()) for k, (rule, good) in enumerate(RULES) for m in re.finditer(rule, text) if good(m.group())
        )
        assert pii.base_spans(text) == want, text


def test_decoding_equals_all_segmentations():
    rng = np.random.default_rng(8)
    model = pii.Model(rng.normal(size=(len(pii.FEATURES), 4)), rng.normal(size=(5, 5)))
    for text in ("+1 (202) 555-0101 4111111111111111", "10.1.2.3 a.b@c.de 77", "4111 1111 1111 1111 1.2.3.4"):
        run = pii.candidates(text, pii.runs(text)[0])

        def segmentations(at, run=run):
            if at == run.units:
                yield []
                return
            for rest in segmentations(at + 1):
                yield [(at, 1, 4), *rest]
            for k in range(1, run.units - at + 1):
                if (at, k) in run.rows:
                    for kind in range(4):
                        for rest in segmentations(at + k):
                            yield [(at, k, kind), *rest]

        def value(parts, run=run):
            kinds = [4, *[kind for *_, kind in parts], 4]
            own = sum(model.score(run.rows[i, k])[kind] for i, k, kind in parts if kind < 4)
            return own + sum(model.turns[a][b] for a, b in zip(kinds, kinds[1:]))

        best = max(segmentations(0), key=value)
        assert model.decode(run) == [p for p in best if p[2] < 4]


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.2
    chances = [(0.2, 0.002)] * 10 + [(0.3, 0.2)]  # ten rare good voters, one common bad one
    v = np.zeros((4000, 12), np.int8)
    for j, (hit, false) in enumerate(chances):
        v[:, j] = np.where(truth, rng.random(4000) < hit, rng.random(4000) < false)
    v[:, 11] = -(v[:, :10].sum(1) == 0).astype(np.int8)
    model = toxicity.fit_label_model(v, 0.2)
    shown = [(truth[v[:, j] != 0] == (model.side[j] > 0)).mean() for j in range(12)]
    assert np.abs(model.accuracy - shown).max() < 0.15  # found without a label
    assert model.accuracy[:10].min() > 0.85 > 0.5 > model.accuracy[10]
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.95
    twin = np.hstack([v[:, :1], v])
    again = toxicity.fit_label_model(twin, 0.2)
    assert [0, 1] in again.pairs.tolist()
    # the twin's vote counts once: posteriors are about those without it
    assert np.abs(again.posterior(twin) - model.posterior(v)).mean() < 0.02


def test_label_model_posterior_is_bayes_over_both_classes():
    """Posterior against the joint chance of class and votes, enumerated from tables of the chances."""
    rng = np.random.default_rng(6)
    prior, side = 0.3, np.array([1.0, 1.0, -1.0, 1.0])
    fires = rng.uniform(0.05, 0.9, (2, 4))  # chance to vote, by class and voter
    pairs = np.array([[0, 1], [1, 3]])
    lifts = rng.uniform(0.5, 1.5, (2, 2))  # P(both) / (P(one) P(other)), by class and edge
    by_side = np.stack([(1 - prior) * fires[0], prior * fires[1]])
    accuracy = np.where(side > 0, by_side[1], by_side[0]) / by_side.sum(0)
    model = toxicity.LabelModel(prior, math.log(prior / (1 - prior)), side, accuracy, pairs, np.log(lifts[1] / lifts[0]))
    for votes in itertools.product((0, 1), repeat=4):
        chance = [1 - prior, prior]
        for k in (0, 1):
            for j, fired in enumerate(votes):
                chance[k] *= fires[k, j] if fired else 1
            for e, (a, b) in enumerate(pairs):
                chance[k] *= lifts[k, e] if votes[a] and votes[b] else 1
        found = model.posterior(np.array([votes]) * side.astype(int))[0]
        assert abs(found - chance[1] / sum(chance)) < 1e-9


def test_forest_has_the_greatest_strength():
    rng = np.random.default_rng(7)
    for _ in range(30):
        strength = np.triu(rng.random((5, 5)), 1)
        strength += strength.T
        strength[strength < 0.3] = 0
        pairs = [(a, b) for a in range(5) for b in range(a) if strength[a, b] > 0.3]

        def joined(edges):
            seats = list(range(5))
            for a, b in edges:
                if seats[a] == seats[b]:
                    return None
                seats = [seats[a] if s == seats[b] else s for s in seats]
            return edges

        choices = (c for n in range(5) for c in itertools.combinations(pairs, n) if joined(c) is not None)
        best = max(sum(strength[a, b] for a, b in c) for c in choices)
        made = toxicity._forest(strength, 0.3)
        assert joined(made.tolist()) is not None
        assert abs(sum(strength[a, b] for a, b in made) - best) < 1e-12


def test_lexicon_looks_at_clean_terms_only_without_toxic_ones():
    lexicon = toxicity.Lexicon({"vilest": 0}, {"grim": 1}, {"kindly": 2})
    rows = np.stack([lexicon.features(t) for t in ("kindly do", "kindly vilest", "Grimout", "plain", "", "vilest " + "word " * 120)])
    v = toxicity.votes(rows, lexicon)
    assert v[:, :3].tolist() == [[0, 0, -1], [1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    stray, none = (3 + toxicity.PATTERNS.index(name) for name in toxicity.CALM)
    assert v[:, stray].tolist() == [0, 0, 0, 0, 0, -1] and v[:, none].tolist() == [-1, 0, 0, -1, -1, 0]


PAGES = {
    "<p>a<p>b <b>c</b> d<br>e": "a\n\nb c d\ne",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>after": "- x\n- y\n  - z\n- w\n\nafter",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi fruit<td>12</table>t": "Name        Qty\napple       3\nkiwi fruit  12\n\nt",
    "<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>": "wide one\na  b",
    "<div>a<div hidden>no</div><i style='display: none'>no</i>b</div>": "ab",
    "<pre>a\n  b</pre>c": "a\n  b\n\nc",
    "a < b &amp; c &lt;d&gt;<!-- x --><script>no</script>": "a < b & c <d>",
    "<title>no</title><details><summary>s</summary>no</details>": "s",
    "<p title='>'>q</b></i>z<!-- c": "qz",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.page_text(page) == PAGES[page]


LONG = "one sentence " * 8 + "of more than sixty characters"
TABLES = {
    f"<table><tr><td>k<td>{LONG}<td>1<tr><td>key<td>b<td>2</table>": f"k    {LONG}  1\nkey  {'b':{len(LONG)}}  2",
    "<table><tr><td>a<br>b<td>1<tr><td>long<td>2<br>3<td>x</table>": "a     1\nb\nlong  2  x\n      3",
    "<table><tr><td><ul><li>p<li>q</ul><td>r</table>": "- p  r\n- q",
    "<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>d<td>e</table><td>f</table>": "a  b  c  f\n   d  e",
    "<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e<tr><td>F<td>g<td>h</table>": "A  b  c\n   d  e\nF  g  h",
    "<table><tr><td>a<td rowspan=2>b<br>c<br>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>": "a  b  e\nf  c  g\n   d\nh  i  j",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><thead><tr><th rowspan=9>H<th>I<tbody><tr><td>x<td>y</table>": "H  I\nx  y",
    "<table><tr><th colspan=2>wide one<th>c<tr><td>a<td>b<td>d</table>": "wide one  c\na  b      d",
    "<table><tr><td><tr><td>a<td><td>b</table>": "a  b",
}


@pytest.mark.parametrize("page", TABLES)
def test_tables(page):
    assert html_text.page_text(page) == TABLES[page]


FOREIGN = {
    "let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>.": "let x= 1 2 .",
    "<math><semantics><mi>y</mi><annotation>tex</annotation></semantics></math>": "y",
    "a<math display=block><mi>b</mi></math>c": "a\nb\nc",
    "<svg><title>no</title><defs><text>no</text></defs><rect/>no<g/><text x=1>left <tspan>part</tspan></text><text>right</text></svg>z":
        "left part right z",
    "<svg><style/><title/><text>a &amp; <![CDATA[b < &amp; c]]></text></svg>": "a & b < &amp; c",
    "<svg><foreignObject><div>in<p>side</div></foreignObject><desc>no</desc></svg>": "in\n\nside",
    "<svg><path d=x><circle></svg>after <svg/>all": "after all",
    "<svg><g><p>broken out": "broken out",
    "<svg><text display=none>no</text><text style='display:none'>no</text><text>x</text></svg>": "x",
    "<text>plain <title>no</title></text>": "plain",
}


@pytest.mark.parametrize("page", FOREIGN)
def test_formulas_and_labels(page):
    assert html_text.page_text(page) == FOREIGN[page]


def test_padding_of_tables_is_bounded():
    rows = 20_000
    page = "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>a<td>b" * rows + "</table>"
    text = html_text.page_text(page)
    assert len(text) < 3_000_000 and text.split() == ["x" * 50_000, "y", *["a", "b"] * rows]
    html_text.page_text("<table>" + "<td colspan=1000 rowspan=65534>a" * 5000 + "<tr><td>b" * 5000 + "</table>")


def test_odd_pages_end():
    assert html_text.page_text(None) == ""
    assert html_text.page_text("<div>" * 20_000 + "x") == "x"
    assert "x" in html_text.page_text("<table><tr><td>" * 500 + "x")
    html_text.page_text("<a '" * 20_000)
