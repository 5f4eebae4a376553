"""A training-data pipeline over ``documents``: language ID, near-dedup,
secret redaction, source mixing and tokenisation, each by its operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the
last keep the columns of ``documents``; the last returns a row for each
document of the mix: doc_id, n_tokens, ids (token ids as little-endian
unsigned 32-bit integers) and round_trip (whether they decode to the text).

A stage's rules for nulls, empty and repeated rows are its operator's: a
document without letters or of an uncertain language goes, of a group of near
duplicates (five-word shingles, similarity 0.8) the smallest id stays,
secrets are replaced in place, and the mix repeats or cuts documents towards
the sources' targets. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import op1_secrets, op3_minhash, op4_bpe, op5_mix, op6_language
from wirelens.llm.common import cut, table

#: Most texts of a batch that goes to the tokeniser in Python.
ROWS = 1024


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_language.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_minhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_secrets.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_mix.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = op4_bpe.with_text(op4_bpe.with_ids(docs.select("doc_id", "text")))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    out = d.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                   (F.col("decoded") == text).alias("round_trip"))
    return cut(out, "pipeline-tokens", ROWS)  # batches of few whole texts and their ids


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Not to be had in SQL (MinHash links, Bayesian language ID, BPE); tests/llm
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
