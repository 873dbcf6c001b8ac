"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.op4_secret_links import redact_secrets
from roadloom.llm.op5_byte_bpe import encode
from roadloom.llm.op6_raking import sample_mix
from roadloom.llm.op7_host_rules import keep_quality
from roadloom.llm.op8_simhash import keep_one
from roadloom.plans.staging import drop_staged, scope, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose host is rejected, go. Null and empty texts fail; rows without a host
    form one; repeated rows are judged alike. An empty table stays empty. All columns stay, whatever their names."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest id. Texts without words are one group; rows
    without an id stay; of rows that repeat an id, one stays. An empty table stays empty. All columns stay."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the identifiers linked with them are replaced in the texts, and n_chars is renewed. No row goes:
    null, empty and clean texts stay as they are. An empty table stays empty. All columns stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics, at a rate of 0.8 of all words, or
    at the greatest below it at which the targets are met. Null sources and languages are values like others; rows that repeat an id are drawn
    alike; texts without words are drawn by their cell. An empty table stays empty. All columns stay."""
    return sample_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and ids: the texts' token ids as little-endian unsigned 32-bit integers. Null
    and empty texts have none; repeated rows each get theirs. An empty table stays empty. Other columns are dropped."""
    return encode(docs.select("doc_id", "text", "lang", "source")).drop("text")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]
#: XXH64 fingerprints, the linking of secrets and BPE have no SQL form; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written and read again by the next; the tables behind them are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark) as keep:
            new = keep(staged(stage(spark, docs, sf_dir), f"stage-{at}"))
        drop_staged(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
