"""Corpus pipeline: five stages, each calling one operator of ``flowlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.  Nulls, empty tables, repeated rows and extra columns are treated as each
operator's docstring states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import stages
from flowlens.llm.common import prepare, written
from flowlens.sources.tables import read_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("pii", stages.redact),
    ("mixing", stages.mix_sources),
    ("bpe", stages.tokenize),
]

# No SQL engine has the trained models, XXH64 votes or the tokenizer: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
