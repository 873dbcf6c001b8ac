"""Byte-level BPE through tiktoken: a local rank file, pre-splitting at safe boundaries, raw-byte decoding."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A text longer than this (characters) is cut at safe boundaries into parts of about this length.
PART_CHARS = 1 << 16
#: White space as the library's expressions see it.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits in any version of Unicode, and signs that are neither.
_WORD, _SIGN = "A-Za-z0-9\u00c0-\u00d6\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: No match of the pattern spans the place before white space that follows something else, or between a letter or
#: digit and a sign; and what follows is matched the same wherever it begins: the pattern looks ahead only past white
#: space.
_SAFE = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[{_WORD}])(?=[{_SIGN}])")
_WHOLE = r"[\s\S]+"
_ENCODINGS: dict = {}


@functools.cache
def _long_run(least: int) -> re.Pattern:
    return re.compile(f"[{_BLANK}]{{{least},}}")


def _cut(text: str, size: int) -> list[str]:
    parts, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None or m.start() == len(text):
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def safe_parts(text: str, size: int = PART_CHARS) -> list[tuple[str, bool]]:
    """``text`` cut into parts that encode to the same ids as the whole; with each, whether it is one match.

    A run of as much white space as a part is a part of its own, without its last character unless it ends the text:
    the pattern takes it as one match, but its matcher backtracks over the run and fails on very long ones. Any other
    run without a safe place is a single match too and stays whole.
    """
    if len(text) <= size:
        return [(text, False)]
    parts, at = [], 0
    for m in _long_run(max(2, min(size, PART_CHARS))).finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [(p, False) for p in _cut(text[at : m.start()], size) if p]
        parts.append((text[m.start() : end], True))
        at = end
    return parts + [(p, False) for p in _cut(text[at:], size) if p]


def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's content, kept by each Python worker."""
    key = (ranks, pattern)
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def encode_text(ranks: bytes, pattern: str, text: str | None, size: int = PART_CHARS) -> np.ndarray:
    """The ids of the whole text. A part that is one match is encoded by the same ranks without a split."""
    parts = [_encoding(ranks, _WHOLE if one else pattern).encode_to_numpy(p, disallowed_special=()) for p, one in safe_parts(text or "", size)]
    return np.concatenate(parts).astype("<u4") if len(parts) > 1 else parts[0].astype("<u4")


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers).

    ``ranks`` is the path of a rank file on the driver, which goes to the tasks by broadcast (under 2 MB).
    ``pattern`` must be of the family that :func:`safe_parts` explains. Null text: no ids. Empty table: no rows.
    Repeated rows each get their ids. Texts of any length, whatever runs they hold, are encoded whole. Columns of
    ``docs`` named n_tokens or ids are replaced; all others stay. One row is in memory at a time, beside its Arrow
    batch.
    """
    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make(texts: list) -> list[pa.Array]:
        ids = [encode_text(shared.value, pattern, t, part_chars) for t in texts]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]

    return add_columns(docs, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], make)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` with ``out`` (binary): the raw bytes of the tokens, which need not be valid UTF-8.

    Null ids: null. No ids: no bytes. An id that the ranks don't hold fails. Empty table: no rows. A column named
    ``out`` is replaced, all others stay."""
    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def make(rows: list) -> list[pa.Array]:
        enc = _encoding(shared.value, pattern)
        return [pa.array([None if r is None else enc.decode_bytes(np.frombuffer(r, "<u4").tolist()) for r in rows], pa.binary())]

    return add_columns(encoded, ids, [T.StructField(out, T.BinaryType())], make)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decode(encode(docs).drop("text"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict = {}
