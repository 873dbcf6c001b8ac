"""Exact token counts of whole texts, by transducers compiled from a tokenizer file."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns
from roadloom.llm.transducers import TokenCounter, class_table

FILE = "byte_bpe_50k.json"
_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with n_tokens (long): the tokens of the whole text, without added begin or end tokens.

    ``tokenizer`` is the path of a byte-level BPE file on the driver (under 2 MB), which goes to the tasks by
    broadcast with the table of character classes (1.1 MB). Null and empty texts: 0. Empty table: no rows. Repeated
    rows are counted alike. A column named n_tokens is replaced; all others stay. A special token's string inside a
    text counts as that token, as is the library's default.
    """
    with open(tokenizer or public_tokenizers.path(FILE), "rb") as f:
        spec = f.read()
    TokenCounter(spec, class_table())  # an unsuitable file fails here
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(spec).hexdigest(), spec, class_table()))

    def make(texts: list) -> list[pa.Array]:
        name, content, classes = shared.value
        if name not in _COUNTERS:
            _COUNTERS[name] = TokenCounter(content, classes)
        return [pa.array(_COUNTERS[name].count([t or "" for t in texts]), pa.int64())]

    return add_columns(docs, text, [T.StructField("n_tokens", T.LongType())], make)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = count_tokens(docs.select("doc_id", size.alias("n_bytes"), "text"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict = {}
