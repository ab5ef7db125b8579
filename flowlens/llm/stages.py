"""The stages of ``corpus_pipeline``: each applies one operator to the documents it is given.

All but ``tokenize`` return exactly the columns of their input, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, golay, mixing, pii, toxicity
from flowlens.llm.common import prepare, written
from flowlens.llm.queries import tokenizer_path
from flowlens.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from all labelled documents it is given."""
    prepare(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id, of
    several the one with the least text hash.

    Rows are told apart by a number of their own, not by doc_id: a null doc_id comes after all
    others and never makes rows copies, and an id with two texts is judged by each text.
    """
    prepare(spark)
    own = "_".join(["row", *docs.columns])  # a name that no column has
    # The numbers are stored with the rows, so that both readers see the same.
    docs = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    numbered = docs.select("doc_id", "text", F.col(own).alias("row"), F.xxhash64("text").alias("hash"))
    rows = written(golay.fingerprints(numbered, golay.SHINGLE, "row", "hash"), "fingerprints")
    keep = golay.first_rows(rows).withColumnRenamed("row", own)
    return docs.join(keep, own).drop(own)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text gives way to its kind; n_chars follows."""
    prepare(spark)
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    prepare(spark)
    return bpe.tokenized(docs, tokenizer_path())
