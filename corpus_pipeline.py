"""From raw documents to token counts: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and hands the reread table to the next stage. All but the last return the columns of documents.

In every stage a null text counts as empty, a null id or source is a value of its own, a repeated row is a row of its own
unless the stage says otherwise, columns whose names clash with working columns pass through, and an empty table gives an
empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from splitlab.llm import bpe, mixing, order_minhash, pii, toxicity
from splitlab.llm.frames import in_batches
from splitlab.session import discard, written

#: No SQL: the trained stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not score as toxic. It learns from the labelled documents among ``docs``.

    Empty texts stay; repeated rows get one score; without toxic and clean labels all documents stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of equal and near-equal texts.

    Empty and null texts are one class. Of repeated rows one stays, of rows with one id and text the least in all columns.
    """
    return order_minhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities in their texts replaced by <KIND>; n_chars, where there is one, follows the new text.

    Null texts stay null and keep their n_chars; overlapping entities become one, the first's.
    """
    model = pii.train(docs)
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches):
        for batch in batches:
            texts = [None if t is None else pii.masked(t, model) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if length is not None:
                sizes = [n if t is None else len(t) for t, n in zip(texts, batch.column(length).to_pylist(), strict=True)]
                columns[length] = pa.array(sizes, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_batches(docs, work, docs.schema, arrow=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them, 0 to 3; repeats keep their id.

    Ties in size stand in the order of a hash of the id; texts without a word go along at their source's rate.
    """
    return mixing.emit(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row that is left; empty texts have no tokens."""
    return bpe.digest_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # no later stage reads it
        docs = done
    return docs
