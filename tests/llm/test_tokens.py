from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from roadloom.llm import op3_token_counts as op3
from roadloom.llm import op5_byte_bpe as op5
from roadloom.llm.transducers import BEGIN, MergeTransducer, TokenCounter, class_table, entry_states, piece_starts

BITS = ["a", "s", "t", "re", "r", "v", "e", "l", "ll", "d", "m", "'", " ", "  ", "\n", "\t", " ", "　", "1", "٣", "!", "é", "中", "😀", "'s", "'re ", "'ll", "don't", "<|endoftext|>", "\x1c", "\x85", "᠎", "​", "_", "\r\n", "the", "ing", " \n", "֋"]


def texts(n, seed, top=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, top))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def classes():
    return class_table()


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_counts_equal_the_library(library, classes, chunk):
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        counter = TokenCounter(f.read(), classes, chunk)
    sample = texts(1500, chunk) + ["a" * 5000, " " * 3000 + "x", "ab" * 2000, "é" * 3000, ""]
    assert counter.count(sample).tolist() == [len(x.ids) for x in library.encode_batch(sample, add_special_tokens=False)]
    assert counter.count([]).tolist() == []


def test_forgetting_changes_nothing(library, classes):
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        counter = TokenCounter(f.read(), classes)
    counter.pieces.limit = counter.pieces.merges.limit = 20
    sample = texts(300, 9)
    assert counter.count(sample).tolist() == [len(x.ids) for x in library.encode_batch(sample, add_special_tokens=False)]


def test_fits_by_parts_equals_merging():
    rng = random.Random(3)
    merges, tokens = [], ["a", "b", "c"]
    while len(merges) < 25:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            merges.append([a, b])
            tokens.append(a + b)
    t = MergeTransducer(merges)
    assert t.plain
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert t.count(word) == len(t.merge(word)), word


def test_scan_composes_maps():
    maps = np.random.default_rng(0).integers(0, 11, (37, 11)).astype(np.uint8)
    state, want = BEGIN, []
    for m in maps:
        want.append(state)
        state = m[state]
    assert entry_states(maps).tolist() == want


def test_piece_starts_do_not_depend_on_chunks(classes):
    text = "".join(texts(30, 5)) + "\ud800"
    kinds = np.frombuffer(classes, np.uint8)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    assert all(np.array_equal(piece_starts(kinds, c), piece_starts(kinds, 64)) for c in (1, 2, 3, 1000))


def test_count_rows(odd, none, library):
    rows = op3.count_tokens(odd.withColumnRenamed("n_chars", "n_tokens")).collect()
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows) and len(rows) == 9
    assert op3.count_tokens(none).count() == 0


def test_count_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3.op3_token_counts(spark, sf).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


@pytest.fixture(scope="module")
def plain():
    with open(P.path(op5.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(op5.RANKS), "rb") as f:
        return f.read()


CUTS = [*BITS, " " * 5, "\n" * 4, "\t\t", "\u3000\u3000", "中文", "。", "，", "가", "テ", "x)", "9-", "\x1f"]


def test_parts_are_safe(plain, ranks):
    rng = random.Random(7)
    sample = texts(400, 2, 60) + ["".join(rng.choice(CUTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in sample + ["word and 12 more\n\n  lines " * 40, "x" * 500, " " * 500, "中。" * 300, "a" + "\n" * 300, "\t" * 300 + "b"]:
        for size in (1, 5, 17):
            assert "".join(p for p, _ in op5.safe_parts(t, size)) == t
            assert op5.encode_text(ranks, P.PATTERN, t, size).tolist() == plain.encode_ordinary(t), (t, size)
    assert max(len(p) for p, one in op5.safe_parts("中文，字。" * 1000, 50) if not one) < 60


@pytest.mark.parametrize("before, after", [("", ""), ("a", ""), ("", "b"), ("1.\n", "  z")])
def test_long_runs(plain, ranks, before, after):
    for run in (" ", "\t", "\n", " \n\t", "x", "中", "=", "é1"):
        some, all_ = (before + (run * (n // len(run) + 1))[:n] + after for n in (200_000, 5_000_000))
        assert op5.encode_text(ranks, P.PATTERN, some).tolist() == plain.encode_ordinary(some)
        if before == "1.\n":
            assert plain.decode_bytes(op5.encode_text(ranks, P.PATTERN, all_).tolist()) == all_.encode()


def test_encode_and_decode(odd, none, plain):
    rows = op5.decode(op5.encode(odd.withColumnRenamed("lang", "ids"), part_chars=50)).collect()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert len(rows) == 9 and op5.encode(none).count() == 0


def test_a_row_of_white_space_survives(spark):
    df = spark.createDataFrame([(1, " " * 1_500_000), (2, "a\n" + "\t" * 1_500_000 + "b"), (3, "x")], "doc_id long, text string")
    for r in op5.decode(op5.encode(df)).collect():
        assert r["decoded"] == r["text"].encode()


def test_decoding_is_raw(spark, plain):
    half = np.array([plain.encode_single_token(bytes([b])) for b in "é".encode()[:1]], "<u4").tobytes()
    rows = op5.decode(spark.createDataFrame([(half,), (None,)], "ids binary")).collect()
    assert [r["decoded"] for r in rows] == [b"\xc3", None]


def test_encode_query(spark, sf, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5.op5_byte_bpe(spark, sf).collect():
        ids = plain.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
