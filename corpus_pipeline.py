"""The corpus pipeline: quality rules, near-dedup, decontamination, PII masking, BPE.

Each stage is one operator of lodestrand.llm over all rows that the stage before
it kept. The four first return the columns of documents; the last returns the
digests of the encoding. Stages are separate jobs with a Parquet table between
them, so a lost executor costs tasks of one stage only.

Defined cases: a null, empty or short text fails the quality rules and goes;
rows with a null id are judged like others, and stand for their group only where
it has no id; of repeated rows one stays; texts of any length pass whole; other
columns, whatever their names, pass unchanged up to the last stage; an empty
table gives no rows. n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import bpe, decontaminate, pii, quality, simhash
from lodestrand.llm.queries import tokenizer_path
from lodestrand.llm.shared import table, written


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return _recounted(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked."""
    return _recounted(pii.redacted(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL has no tokenizer and no EM; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
