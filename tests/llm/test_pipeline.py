"""The pipeline's stages against brute force on the small tables, and the queries' registration."""

import __spark_entry__
import corpus_pipeline
from splitlab.llm import bpe, mixing, order_minhash, pii, queries, toxicity
from splitlab.session import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]

    clean = written(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    model = toxicity.train(docs, labels)
    want = [r for r in rows if model.score(r[1]) < 0.5]
    assert sorted(map(tuple, clean.collect())) == sorted(want)

    unique = written(corpus_pipeline.drop_near_copies(spark, clean, SF), "t")
    from tests.llm.test_operators import brute_classes

    classes = brute_classes([(r[0], r[1]) for r in want])
    want = [r for r in want if classes[r[0], r[1]] == r[0]]
    assert sorted(map(tuple, unique.collect())) == sorted(want)

    masked = written(corpus_pipeline.mask_personal_data(spark, unique, SF), "t")
    spans = pii.train(unique)
    want = [(r[0], t := pii.masked(r[1], spans), r[2], r[3], len(t)) for r in want]
    assert sorted(map(tuple, masked.collect())) == sorted(want)
    assert masked.schema == docs.schema

    mix = written(corpus_pipeline.mix_sources(spark, masked, SF), "t")
    taken = {r.doc_id: r.copies_ for r in mixing.mix(masked).collect()}
    want = [r for r in want for _ in range(taken[r[0]])]
    assert sorted(map(tuple, mix.collect())) == sorted(want) and mix.columns == docs.columns

    last = corpus_pipeline.encode(spark, mix, SF)
    tool = bpe.codec(bpe.public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe.public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.n_tokens) for r in last.collect()) == sorted((r[0], len(tool.encode(r[1]))) for r in want)


def test_pipeline_keeps_null_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.union(spark.createDataFrame([(-1, None, None, None, None)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:3]:
        odd = written(stage(spark, odd, SF), "t")
    assert odd.where("doc_id = -1").count() == 1
    assert order_minhash.one_of_each(odd.limit(0)).count() == 0


def test_every_operator_has_its_query():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "byte_bpe"]
