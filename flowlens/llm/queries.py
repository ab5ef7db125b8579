"""The registered queries of this subpackage: one ``opN_<name>`` per operator and ``pipeline``.

Every query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import bpe, fim, fmindex, golay, langid, mixing, mtree, ngram_lm, orchard, pii, simhash, toxicity, warc
from flowlens.llm.common import prepare
from flowlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary (its place is a parameter of the operator)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_mtree_top_k", mtree.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return mtree.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.query(docs, tokenizer_path())


@query("op3_golay_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return golay.query(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op4_pareto_mixing", mixing.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixing.query(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return simhash.query(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op6_warc", warc.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.query(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return toxicity.query(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return langid.query(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.query(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op10_backoff_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return ngram_lm.query(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op11_fill_in_middle", fim.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of every document, as digests of the output and of the text restored from it."""
    return fim.query(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op12_fm_decontamination", fmindex.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return fmindex.query(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query("op13_orchard_codes", orchard.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks learned from them."""
    return orchard.query(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
