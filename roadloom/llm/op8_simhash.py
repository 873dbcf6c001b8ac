"""SimHash near-duplicates through multi-index hashing.

Fingerprints are cut into segments, each with a table of its values. Two fingerprints within the limit agree in some
segment up to that segment's small radius, so enumerating the Hamming ball of each segment and fetching the tables'
matches misses no pair; complete distances are verified on what is fetched.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns
from roadloom.llm.text import fresh
from roadloom.operators.components import connected_components
from roadloom.plans.staging import shuffled, staged

BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included; 0 without words.

    A-Z are lower-cased, words are what ASCII white space separates; fewer words than ``words`` make one shingle.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest, n = xxhash.xxh64_intdigest, len(w) - words + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with the fingerprint as a signed long in column ``out``, which is replaced if there is one.

    Null text: empty; without words: 0. Repeated rows get equal ones. Empty table: no rows. All other columns stay.
    """

    def make(texts: list) -> list[pa.Array]:
        bits = np.array([fingerprint(t, words, seed) for t in texts], np.uint64)
        return [pa.array(bits.view(np.int64), pa.int64())]

    return add_columns(docs, text, [T.StructField(out, T.LongType())], make)


def segment_plan(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. The radii are at most 2 and add up so that a pair that exceeds every
    radius differs in more than ``max_bits`` bits."""
    extra = max(0, max_bits + 1 - segments)
    if extra > 2 * segments:
        raise ValueError("too few segments: a radius over 2 would be needed")
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), w, extra // segments + (i < extra % segments)) for i, w in enumerate(widths)]


def segments_for(count: int, max_bits: int) -> int:
    """Segments for so many different fingerprints: the most that keep buckets of a segment's values small, so that
    keys grow with the logarithm of the count, as multi-index hashing prescribes."""
    least = next(n for n in range(1, BITS + 1) if n * 3 > max_bits)
    return max(least, min(max_bits // 2 + 1, BITS // max(1, (max(count, 1) >> 9).bit_length())))


def _segment(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def _cleared(value: Column, width: int) -> Column:
    """``value`` with each of its set bits cleared in turn."""
    masks = F.array(*[F.lit(1 << j) for j in range(width)])
    return F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != 0), lambda m: value.bitwiseXOR(m))


def _ball(value: Column, width: int, radius: int) -> Column:
    """``value`` and what it becomes when up to ``radius`` (0 to 2) of its set bits are cleared.

    Two values that differ in no more bits meet: each clears the bits that the other lacks.
    """
    if radius == 0:
        return F.array(value)
    if radius == 1:
        return F.concat(F.array(value), _cleared(value, width))
    pairs = F.array(*[F.lit(1 << i | 1 << j) for j in range(width) for i in range(j)])
    twice = F.transform(F.filter(pairs, lambda m: value.bitwiseAND(m) == m), lambda m: value.bitwiseXOR(m))
    return F.concat(F.array(value), _cleared(value, width), twice)


def _close_groups(bits: DataFrame) -> DataFrame:
    """Links that settle dense groups without their pairs: all fingerprints that become one value when at most one
    set bit is cleared differ in two bits at most, so each links with the smallest of them."""
    whole = F.array(*[F.lit(-(1 << 63) if j == 63 else 1 << j) for j in range(BITS)])
    b = F.col("b")
    near = F.transform(F.filter(whole, lambda m: b.bitwiseAND(m) != 0), lambda m: b.bitwiseXOR(m))
    keys = bits.select("b", F.explode(F.concat(F.array(b), near)).alias("key"))
    low = keys.groupBy("key").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi")
    return keys.join(shuffled(low), "key").where("b > lo").select(F.col("b").alias("src"), F.col("lo").alias("dst")).distinct()


def link_groups(bits: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """(b, group) for the distinct longs in column ``b``: ``group`` is one member of all that are reachable by
    links of at most ``max_bits`` differing bits. ``segments``: by default, as their number asks for.

    Groups that differ by single bits are settled first; then only links between different groups are searched, so
    a dense group emits no pairs. A bucket that holds much is a hot key of a sort-merge join, which adaptive
    execution splits. No side of a join is broadcast, whatever Spark takes its size for.
    """
    bits = staged(bits.select("b").distinct(), "bits")
    segments = segments or segments_for(bits.count(), max_bits)
    if max_bits >= 2:
        first = connected_components(_close_groups(bits)).withColumnRenamed("node", "b")
        first = staged(first, "first")
        bits = staged(bits.join(shuffled(first), "b", "left").select("b", F.coalesce("component", "b").alias("g")), "grouped")
    else:
        bits = bits.select("b", F.col("b").alias("g"))
    table, probe = [], []
    for i, (shift, width, radius) in enumerate(segment_plan(max_bits, segments)):
        seg = _segment(F.col("b"), shift, width)
        tag = F.lit(i << 60)
        probe.append(F.transform(_ball(seg, width, radius), lambda x: tag.bitwiseOR(x)))  # noqa: B023
        # Of values one bit apart, one becomes the other; of those two bits apart, both may have to clear one.
        table.append(F.transform(_ball(seg, width, max(0, radius - 1)), lambda x: tag.bitwiseOR(x)))  # noqa: B023
    tables = bits.select(F.explode(F.concat(*table)).alias("key"), F.col("b").alias("b2"), F.col("g").alias("g2"))
    probes = bits.select(F.explode(F.concat(*probe)).alias("key"), "b", "g")
    near = F.bit_count(F.col("b").bitwiseXOR(F.col("b2"))) <= max_bits
    hits = probes.join(shuffled(tables), (probes["key"] == tables["key"]) & (F.col("g") != F.col("g2")) & near)
    links = hits.select(F.least("g", "g2").alias("src"), F.greatest("g", "g2").alias("dst")).distinct()
    merged = staged(connected_components(links), "merged")
    return bits.join(shuffled(merged.withColumnRenamed("node", "g")), "g", "left").select("b", F.coalesce("component", "g").alias("group"))


def _components(prints: DataFrame, max_bits: int, segments: int | None) -> DataFrame:
    """(b, component_id) of the fingerprints in ``prints`` (doc_id, b)."""
    groups = staged(link_groups(prints, max_bits, segments), "groups")
    nodes = staged(prints.groupBy("b").agg(F.min("doc_id").alias("low")).join(shuffled(groups), "b"), "nodes")
    # Written apart, so that the join reads nothing but two exchanges and a large group can be split.
    ids = staged(nodes.groupBy("group").agg(F.min("low").alias("component_id")), "ids")
    return staged(nodes.join(shuffled(ids), "group").select("b", "component_id"), "of")


def _prints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    rows = with_fingerprints(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), out="b", words=words)
    return staged(rows.drop("text"), "fingerprints")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest key reachable by links of at most ``max_bits`` differing bits, itself included;
    null keys don't count (a component of only null keys has a null id). Texts without words, null ones too, share
    fingerprint zero. Equal fingerprints are one node, so copies are never paired; repeated rows are copies. Empty
    table: no rows. Other columns are dropped, whatever their names.
    """
    rows = _prints(docs, key, text, words)
    return rows.join(shuffled(_components(rows, max_bits, segments)), "b").select("doc_id", F.lower(F.lpad(F.hex("b"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4, segments: int | None = None, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest key, and all columns, whatever their names.

    Null and empty texts are one group. Rows without a key stay. Rows that repeat a key: those of the group that the
    key stands for count, and of them the one with the least digest of its columns stays, so the choice doesn't
    depend on the run. Empty table: no rows.

    Groups are settled on keys and fingerprints. Keys that go, and keys that repeat, are broadcast up to
    ``broadcast_keys`` of them, which the driver counts, so that texts don't move; beyond it they are shuffled once.
    """
    k = F.col(f"`{key}`")
    rows = _prints(docs, key, text, words)
    of = _components(rows, max_bits, segments)
    per = rows.where("doc_id is not null").join(shuffled(of), "b").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    per = staged(per, "per-key")
    [g] = fresh(docs, "_key")

    def keys(which: str) -> tuple[DataFrame, int]:
        some = per.where(which).select(F.col("doc_id").alias(g))
        n = some.count()
        return (F.broadcast(some) if n <= broadcast_keys else shuffled(some)), n

    (gone, _), (again, repeated) = keys("not stays or n > 1"), keys("stays and n > 1")
    once = docs.join(gone, k == F.col(g), "left_anti")
    if not repeated:
        return once
    rest = docs.join(again, k == F.col(g), "left_semi")
    # The repeated keys' rows alone are measured again, so that each is known by its own text.
    packed = rest.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), k.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    packed = with_fingerprints(packed, out="b", words=words).join(shuffled(of), "b").where("doc_id = component_id")
    first = packed.groupBy("doc_id").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return once.unionByName(first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict = {}
