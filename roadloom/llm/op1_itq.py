"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and reranking.

A rotation is learnt for balanced binary codes (Gong and Lazebnik, 2011). Codes are cut into segments with a table
each; a vector asks each table for its own segment and for what it becomes when bits flip that lie near the border
between 0 and 1, codes are compared by how far their differing bits lie from it, and what is left is reranked by the
cosine of the original vectors. No pair at the threshold is missed (:func:`near_candidates`), so results don't follow
from the layout. Tables fetch a share of all pairs of a label; where that would be too many, labels are compared by blocks
instead (:func:`block_candidates`), and what passes is reranked just so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns, bound_batches
from roadloom.llm.op8_simhash import _cleared, _segment
from roadloom.operators.components import connected_components
from roadloom.plans.staging import shuffled, staged


#: Where a segment's number stands in a key; steps of margins.
TAG, STEPS = 57, 8
#: (words, segments of each) of the search by Hamming balls at any size, as what it finds follows from them.
BALLS = (1, 6)
#: The largest label that tables search: what they fetch grows with its square and is reranked with both vectors each, so
#: larger ones are compared by blocks of so many vectors, at least (but in eight blocks at most) and at most.
MOST_IN_TABLES, BLOCK = 4096, (2048, 32768)
#: Rows of a block that are compared at a time.
_ROWS = 512


@dataclass(frozen=True)
class ItqPolicy:
    """threshold: the least cosine of a link. bits: of a word, at most 64. max_bits: most
    differing bits of candidates, per word. layout: (words, segments of each), by default :func:`layout_for` the
    largest label, which decides the cost alone as complete search takes one word, or else :data:`BALLS`. Otherwise every segment has radius 1, so with one word and
    2 * segments > max_bits no pair within max_bits is missed.
    sample: most vectors on which the rotations are fitted, chosen by a hash of their ids. rounds, seed: of the fit.
    complete: whether no link may be missed; if not, candidates are those within max_bits, by Hamming balls."""

    threshold: float = 0.93
    bits: int = 64
    max_bits: int = 11
    layout: tuple[int, int] | None = None
    sample: int = 5000
    rounds: int = 40
    seed: int = 42
    complete: bool = True


def layout_for(count: int) -> tuple[int, int]:
    """(words, segments of each) for a label of so many vectors: segments of 11, 16 or 21 bits, as many as it takes for
    a pair at the threshold to agree in one of them up to a bit (with a chance of 0.98 or more)."""
    return (1, 6) if count <= 1 << 16 else (3, 4) if count <= 1 << 22 else (7, 3)


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles scaled to length 1, padded with zeros to ``width``; which rows are valid.

    Null and zero vectors and those with null or non-finite components are not valid, and their rows are zero.
    """
    out = np.zeros((len(column), width))
    sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values
    # Scaling by the largest component first keeps squares within range.
    top = np.abs(out).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    out[~ok] = 0
    out[ok] = _scaled(out[ok])
    out[ok] /= np.linalg.norm(out[ok], axis=1, keepdims=True)
    return out, ok


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows without zeros alone, times a power of two that brings their largest component near 1: nothing is rounded
    but what is too small to count."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])


def fit_rotation(x: np.ndarray, bits: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): codes are the signs of (x - mean) @ projection.

    Principal axes, then the rotation that lets the projections lie nearest to the corners of the cube, found by
    turns: signs for a fixed rotation, the best rotation for fixed signs.
    """
    width = x.shape[1]
    bits = min(bits, width)
    mean = x.mean(0) if len(x) else np.zeros(width)
    _, axes = np.linalg.eigh(np.cov(x - mean, rowvar=False).reshape(width, width) if len(x) > 1 else np.eye(width))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds if len(x) else 0):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def fit_word(x: np.ndarray, bits: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fit_rotation` for a whole word: what vectors shorter than that leave is filled by further rotations of
    the principal axes, drawn at random, as learnt ones might repeat the first one's bits."""
    mean, first = fit_rotation(x, bits, rounds, seed)
    parts = [first]
    while sum(p.shape[1] for p in parts) < bits:
        parts.append(fit_rotation(x, bits, 0, seed + 1000 * len(parts))[1])
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def encode(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """A word of code for each row."""
    signs = ((rows - mean) @ projection > 0).astype(np.uint8)
    wide = np.zeros((len(rows), 64), np.uint8)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").reshape(-1)


def flips(codes: np.ndarray, margins: np.ndarray, segments: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the tables to ask: each segment of a row's code, and what it becomes by flips of bits whose squared
    ``margins`` (rows by bits) sum up to half of ``share``, or a quarter for one bit alone.

    Of two vectors whose margins on the differing bits, a and b, have the sum of (a + b)^2 within the share, one has the
    sum of its own squares within half of it, and with one such bit within a quarter."""
    rows, keys = [], []
    for i, (s, w) in enumerate(places_of(segments)):
        row, value = np.arange(len(codes)), (codes.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << w) - 1)
        total, n = np.zeros(len(codes)), np.zeros(len(codes), np.int8)
        for j in range(min(w, margins.shape[1] - s)):
            more = total + margins[row, s + j]
            ok = more <= share / 2
            row, value = np.concatenate([row, row[ok]]), np.concatenate([value, value[ok] ^ np.uint64(1 << j)])
            total, n = np.concatenate([total, more[ok]]), np.concatenate([n, n[ok] + 1])
        ok = (n != 1) | (total <= share / 4)
        rows.append(row[ok])
        keys.append(value[ok].astype(np.int64) | (i << TAG))
    return np.concatenate(rows), np.concatenate(keys)


def places_of(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of a word."""
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def with_codes(vectors: DataFrame, policy: ItqPolicy, words: int = 1, segments: int = 0) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) with dim, codes (an array of ``words`` longs) and digest, which is null
    where a vector can't link. With ``segments``, also probes (:func:`flips` of the first word) and far: masks of the
    bits whose squared margin is at least 1, 2, ... times a :data:`STEPS`-th of the squared distance at the threshold.

    The rotations are fitted on the driver, on ``policy.sample`` vectors at most. Vectors of several lengths share
    them, padded with zeros, and never link with another length.
    """
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = max(int(width), 1)
    pick = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id", F.lit(policy.seed))).limit(policy.sample)
    rows = [r[0] for r in pick.select("embedding").collect()]
    x, ok = unit_rows(pa.array(rows, pa.list_(pa.float64())), width)
    fits = [fit_word(x[ok], policy.bits, policy.rounds, policy.seed + i) for i in range(words)]
    shared = vectors.sparkSession.sparkContext.broadcast((width, fits))

    def make(column: pa.Array) -> list[pa.Array]:
        wide, turns = shared.value
        units, valid = unit_rows(column, wide)
        first = encode(units, *turns[0])
        codes = np.stack([first, *[encode(units, m, p) for m, p in turns[1:]]], axis=1).reshape(-1)
        codes = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * len(turns), pa.int32()), pa.array(codes, pa.int64()))
        sizes = pa.compute.list_value_length(column).cast(pa.int32())
        keys = [blake2b((np.round(u, 15) + 0.0).tobytes(), digest_size=16).digest() if v else None for u, v in zip(units, valid, strict=True)]
        made = [sizes, codes, pa.array(keys, pa.binary())]
        if not segments:
            return made
        mean, turn = turns[0]
        margins, total = ((units - mean) @ turn) ** 2, distance_of(policy, wide)
        row, asked = flips(first, margins, segments, total / segments)
        order = np.argsort(row, kind="stable")
        starts = np.searchsorted(row[order], np.arange(len(units) + 1))
        level = np.zeros((len(units), STEPS, 64), np.uint8)
        for k in range(STEPS):
            level[:, k, : margins.shape[1]] = margins >= total * (k + 1) / STEPS
        far = np.packbits(level, axis=2, bitorder="little").view("<i8").reshape(-1)
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))
        return [*made, lists(starts, asked[order]), lists(np.arange(len(units) + 1) * STEPS, far)]

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("digest", T.BinaryType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("probes", "far")] if segments else []
    named = vectors.select("vec_id", "label", "embedding", F.col("embedding").alias("_again"))
    return add_columns(named, "_again", fields, make, arrow=True).drop("_again")


def distance_of(policy: ItqPolicy, width: int) -> float:
    """The greatest squared distance of two unit vectors at the threshold, summed over the axes of a word: axes are at
    right angles up to the vectors' length ``width``, and then begin again. With a little more for rounding."""
    return 2 * (1 - policy.threshold) * -(-policy.bits // min(policy.bits, width)) + 1e-9


def near_candidates(classes: DataFrame, segments: int) -> DataFrame:
    """(a, b), a < b, distinct: representatives of one label and length whose vectors may lie at the threshold.

    Where signs differ, coordinates differ by the sum of both margins. Squares of differences sum up to the squared
    distance over all axes, so to its share at most in some segment: there, one of the two asks for the other's value
    (:func:`flips`). What is fetched stays if the differing bits' own squared margins, rounded down to whole
    :data:`STEPS`, don't exceed the distance. Both hold of every pair at the threshold."""
    table = [F.lit(i << TAG).bitwiseOR(_segment(F.col("codes")[0], s, w)) for i, (s, w) in enumerate(places_of(segments))]
    left = classes.select("label", "dim", F.explode("probes").alias("key"), F.col("rep").alias("a"), F.col("codes")[0].alias("ca"))
    right = classes.select("label", "dim", F.explode(F.array(*table)).alias("key"), F.col("rep").alias("b"), F.col("codes")[0].alias("cb"), *[F.col("far")[k].alias(f"far{k}") for k in range(STEPS)])
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    steps = sum((F.bit_count(differ.bitwiseAND(F.col(f"far{k}"))) for k in range(1, STEPS)), F.bit_count(differ.bitwiseAND(F.col("far0"))))
    hits = left.join(right, ["label", "dim", "key"]).where((F.col("a") != F.col("b")) & (steps <= STEPS))
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(classes: DataFrame, policy: ItqPolicy, layout: tuple[int, int] = (1, 6)) -> DataFrame:
    """(a, b), a < b: representatives of one label and length that agree in a segment of their codes up to a bit, and
    whose codes differ in at most ``policy.max_bits`` a word.

    A pair is emitted once: by the first segment whose ball holds it, and there by the one side whose value the
    other reaches by clearing a bit, or by the smaller id if the segments are equal.
    """
    words, segments = layout
    if words == 1 and policy.max_bits >= 2 * segments:
        raise ValueError("too few segments for max_bits")
    places = [(word, s, w) for word in range(words) for s, w in places_of(segments)]
    table, probe = [], []
    for i, (word, s, w) in enumerate(places):
        seg, tag = _segment(F.col("codes")[word], s, w), F.lit(i << TAG)
        table.append(tag.bitwiseOR(seg))
        ball = F.concat(F.array(seg), _cleared(seg, w))
        probe.append(F.transform(ball, lambda x: tag.bitwiseOR(x)))  # noqa: B023
    block = ["label", "dim", "key"]
    left = classes.select("label", "dim", F.explode(F.concat(*probe)).alias("key"), F.col("rep").alias("a"), F.col("codes").alias("ca"))
    right = classes.select("label", "dim", F.explode(F.array(*table)).alias("key"), F.col("rep").alias("b"), F.col("codes").alias("cb"))
    differ = [F.col("ca")[word].bitwiseXOR(F.col("cb")[word]) for word in range(words)]
    left, right = left.alias("l"), right.alias("r")
    on = F.lit(True)
    for c in block:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    at = F.shiftrightunsigned(F.col("l.key"), TAG)
    once = F
    for i, (word, s, w) in enumerate(places):
        d = F.bit_count(_segment(differ[word], s, w))
        once = once.when(d <= 1, (at == i) & ((d == 1) | (F.col("a") < F.col("b"))))
    apart = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    hits = left.join(right, on & (apart <= policy.max_bits * words) & (F.col("a") != F.col("b")) & once)
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_candidates(classes: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, distinct: representatives of one label and length whose vectors, in single precision, have this
    cosine but for rounding. ``vectors``: rep, embedding.

    A label is dealt out to blocks by a hash, and each two blocks meet in a task, which multiplies their matrices by
    parts. So a vector is sent once for each block of its label, and of what is compared only pairs that pass are
    written; a task holds two blocks."""

    def make(column: pa.Array) -> list[pa.Array]:
        sizes = pa.compute.list_value_length(column).to_pylist()
        units = unit_rows(column, max(sizes, default=1))[0].astype("<f4")
        return [pa.array([u[:n].tobytes() for u, n in zip(units, sizes, strict=True)], pa.binary())]

    def run(table: pa.Table) -> pa.Table:
        reps = table["rep"].to_numpy()
        units = np.frombuffer(b"".join(table["embedding"].to_pylist()), "<f4").reshape(len(reps), -1)
        left, one = table["left"].to_numpy(), table["i"][0] == table["j"][0]
        at, to = (np.arange(len(reps)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        # Each of the products and sums may round by a part in 2 ** 24.
        least, other, pairs = threshold - 4 * (units.shape[1] + 4) * 2.0**-24, np.ascontiguousarray(units[to].T), [np.zeros((2, 0), np.int64)]
        for k in range(0, len(at), _ROWS):
            x, y = np.nonzero(units[at[k : k + _ROWS]] @ other >= least)
            x, y = at[k + x], to[y]
            ok = x < y if one else slice(None)
            pairs.append(np.sort(np.stack([reps[x[ok]], reps[y[ok]]]), axis=0))
        a, b = np.concatenate(pairs, axis=1)
        return pa.table({"a": a, "b": b})

    n = F.col("n")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.greatest(F.ceil(n / BLOCK[1]), F.least(F.lit(8), F.ceil(n / BLOCK[0])))
    sizes = sizes.select("label", "dim", blocks.alias("blocks"))
    units = add_columns(vectors.select("rep", "embedding"), "embedding", [T.StructField("embedding", T.BinaryType())], make, arrow=True)
    rows = classes.select("label", "dim", "rep").join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.join(shuffled(units), "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "rep", "embedding")
    return rows.groupBy("label", "dim", "i", "j").applyInArrow(run, "a long, b long")


def rerank(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose original vectors have at least this cosine, in double precision."""
    va, vb = (vectors.select(F.col("rep").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab")
    rows = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(i).flatten().cast(pa.float64())).reshape(batch.num_rows, -1) if uniform(batch.column(i)) else None for i in (2, 3))
            if x is None or y is None:
                width = max(pa.compute.max(pa.compute.list_value_length(batch.column(i))).as_py() for i in (2, 3))
                x, y = unit_rows(batch.column(2), width)[0], unit_rows(batch.column(3), width)[0]
            x, y = _scaled(x), _scaled(y)
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            keep = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def uniform(column: pa.Array) -> bool:
    sizes = pa.compute.min_max(pa.compute.list_value_length(column))
    return len(column) > 0 and sizes["min"].as_py() == sizes["max"].as_py() and sizes["min"].as_py() > 0


def near_duplicates(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", policy: ItqPolicy = ItqPolicy()) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only rows of one label (not null) and one length are compared. Vectors that are null or zero or hold null or
    non-finite components link with nothing, nor do rows without a label or id: no links, their own component, kept.
    Vectors of equal direction are one class, whose members link with one another; classes are compared once, and a
    link between classes counts for each member of the other. Repeated rows are members like others. Empty table:
    no rows. Other columns are dropped. With complete search, labels of more than :data:`MOST_IN_TABLES` vectors make all
    be compared by blocks (:func:`block_candidates`), which misses no link either; a named layout keeps the tables.
    """
    kind = [F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("embedding")]
    vectors = vectors.select(*kind)
    largest = vectors.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    layout = policy.layout or (layout_for(largest) if policy.complete else BALLS)
    by_blocks = policy.complete and policy.layout is None and largest > MOST_IN_TABLES
    rows = staged(with_codes(vectors, policy, 1, 0 if by_blocks else layout[1]) if policy.complete else with_codes(vectors, policy, layout[0]), "codes")
    group = ["label", "dim", "digest"]
    sound = rows.where("label is not null and digest is not null and vec_id is not null")
    heads = sound.groupBy(*group).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("codes", "probes", "far") if c in rows.columns])
    heads = staged(heads, "classes")
    firsts = sound.join(heads.select(*group, "rep"), group).where("vec_id = rep").groupBy("rep").agg(F.first("embedding").alias("embedding"))
    firsts = staged(firsts, "heads")
    if by_blocks:
        pairs = staged(block_candidates(heads, firsts, policy.threshold), "pairs")
    else:
        pairs = near_candidates(heads, layout[1]) if policy.complete else candidates(heads, policy, layout)
    links = staged(rerank(pairs, firsts, policy.threshold), "links")
    sizes = heads.select("rep", "size")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    counts = ends.join(sizes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("outside"))
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    known = heads.join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.select(*group, (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    # Rows that can't link have a null in the join's key or none that matches.
    out = rows.select("vec_id", *group).withColumn("on", F.col("vec_id").isNotNull()).join(known.withColumn("on", F.lit(True)), [*group, "on"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings and, of each, a disturbed and enlarged copy; every fifth comes twice."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), "label", F.col("embedding").cast("array<double>").alias("e"))
    by = F.get(F.array(*[F.lit(a) for a in AMOUNTS]), (F.col("i") % len(AMOUNTS)).cast("int"))
    moved = F.transform("e", lambda x, j: x * 4 * (1 + by * (((F.col("i") * 7 + j * 13) % 11 - 5) / 5)))
    own = lambda k, e: ((F.col("i") * 4 + k).alias("vec_id"), "label", e.alias("embedding"))
    rows = v.select(*own(0, F.col("e"))).unionByName(v.select(*own(1, moved)))
    return near_duplicates(rows.unionByName(v.where("i % 5 = 0").select(*own(2, F.col("e")))))


#: How much copies are disturbed: three leave a copy clearly similar, one doesn't.
AMOUNTS = (0.1, 0.3, 0.4, 0.9)
_COSINE = "list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e))"


def oracle(vectors: str) -> str:
    """All pairs of ``vectors``, a query of vec_id, label and e."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED ({vectors}),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE {_COSINE} >= {ItqPolicy().threshold}),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""


_V = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
_MOVED = f"list_transform(e, lambda x, i: x * 4 * (1 + [{', '.join(f'{a}::DOUBLE' for a in AMOUNTS)}][vec_id % {len(AMOUNTS)} + 1] * (((vec_id * 7 + (i - 1) * 13) % 11 - 5) / 5)))"
_COPIES = f"SELECT vec_id * 4 AS vec_id, label, e FROM ({_V}) UNION ALL SELECT vec_id * 4 + 1, label, {_MOVED} FROM ({_V}) UNION ALL SELECT vec_id * 4 + 2, label, e FROM ({_V}) WHERE vec_id % 5 = 0"
QUERIES = {"op1_itq": op1_itq, "embedding_copies": embedding_copies}
ORACLES = {"op1_itq": oracle(_V), "embedding_copies": oracle(_COPIES)}
