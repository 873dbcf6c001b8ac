"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by curve index, and runs cut.

A shard then covers a compact box of every dimension, so the ranges in its files' footers prune scans by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.text import fresh
from roadloom.plans.order import ranked
from roadloom.plans.staging import staged

BITS = 8
_DIMS = 3


def curve_table(dims: int = _DIMS) -> list[int]:
    """The curve's automaton (Hamilton, 2006): at state * 2^dims + cell, next state * 2^dims + rank of the cell.

    A state is the corner where a cell is entered and the axis along which it is left.
    """
    n, cells = dims, 1 << dims
    turn = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & (cells - 1)
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(w): w for w in range(cells)}
    ones = lambda x: (x ^ (x + 1)).bit_length() - 1
    table = [0] * (cells * n * cells)
    for corner in range(cells):
        for axis in range(n):
            for cell in range(cells):
                w = rank[turn(cell ^ corner, axis + 1)]
                entry = gray(2 * ((w - 1) // 2)) if w else 0
                along = 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n
                to = (corner ^ turn(entry, n - (axis + 1) % n)) * n + (axis + along + 1) % n
                table[(corner * n + axis) * cells + cell] = to * cells + w
    return table


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """The index along the curve of the cell with these coordinates (0 to 2^bits - 1), as a long."""
    n = len(dims)
    table = F.array(*[F.lit(x) for x in curve_table(n)])
    masks = F.array(*[F.lit(1 << i) for i in range(bits - 1, -1, -1)])

    def step(acc: Column, mask: Column) -> Column:
        cell = F.lit(0)
        for d in dims:
            cell = cell * 2 + F.when(d.bitwiseAND(mask) != 0, 1).otherwise(0)
        out = F.get(table, acc["state"] * (1 << n) + cell)
        return F.struct((out / (1 << n)).cast("int").alias("state"), (acc["at"] * (1 << n) + out % (1 << n)).cast("long").alias("at"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(masks, start, step, lambda a: a["at"])


def ordinal(df: DataFrame, column: str, bits: int, out: str, broadcast_values: int = 100_000) -> DataFrame:
    """``df`` with ``column`` quantised to ``bits`` by the order of its distinct values; null: before all others."""
    values = df.select(column).distinct()
    rank, value = fresh(df, "_rank", "_value")
    known = ranked(values, F.asc_nulls_first(column), out=rank)
    n = known.count()
    side = known.select(F.col(column).alias(value), F.floor(F.col(rank) * (1 << bits) / max(n, 1)).cast("int").alias(out))
    if n <= broadcast_values:
        side = F.broadcast(side)
    return df.join(side, F.col(column).eqNullSafe(F.col(value))).drop(value)


def shard_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", shards: int = 16, bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot and curve (its index).

    The dimensions are source, language (by order of value) and size (by its logarithm); the law is ``rows``: the
    order by curve, text digest and key is cut into ``shards`` runs whose counts are at most one apart. Equal texts
    of one source and language lie side by side. Null text: size 1, CRC 0. Null source or language: a value of its
    own. Repeated rows each get a slot. Fewer rows than shards: some shards are empty. Empty table: no rows. Only
    digests are sorted; the texts stay where they are.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{lang}`").alias("lang"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("digest"),
    )
    rows = staged(rows, "digests")
    rows = ordinal(ordinal(rows, "source", bits, "x"), "lang", bits, "y")
    z = F.least(F.floor(F.log2(F.col("size").cast("double")) * ((1 << bits) / 32)), F.lit((1 << bits) - 1)).cast("int")
    rows = rows.withColumn("curve", curve_index([F.col("x"), F.col("y"), z], bits))
    rows = ranked(rows.drop("x", "y"), "curve", "digest", F.asc_nulls_first("doc_id"))
    n = rows.count()
    # Shard s holds the ranks from floor(s * n / shards) on.
    out = rows.withColumn("shard", F.expr(f"cast(({shards} * (rank + 1) - 1) div {max(n, 1)} as int)"))
    slot = F.expr(f"rank - cast(shard as bigint) * {n} div {shards}")
    return out.select("doc_id", "source", "lang", "size", "text_crc32", "shard", slot.alias("slot"), "curve")


def write_shards(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id", shard: str = "shard") -> None:
    """Write ``docs`` as one folder of Parquet per shard (``shard=0`` and so on), each sorted along the curve.

    Keys that are null or repeated have no row of their own in the plan: an error before anything is written. A
    column of ``docs`` named ``shard`` is an error too, as a folder's name would hide it; others may have any name.
    Null and empty texts are rows like others. Empty table: an empty folder.
    """
    if shard.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {shard}; name another")
    bad = plan.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if bad:
        raise ValueError("keys must be unique and not null")
    k, slot = fresh(docs, "_doc", "_slot")
    side = plan.select(F.col("doc_id").alias(k), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = docs.join(side, F.col(f"`{key}`") == F.col(k)).drop(k)
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = 16, bits: int = BITS) -> str:
    """The same plan in SQL: the curve's automaton in steps, and CRC-32 by a table of bytes."""
    steps, last = [], "(SELECT *, 0 AS s0, 0::BIGINT AS c0 FROM z)"
    for i in range(bits):
        cell = f"(x >> {bits - 1 - i} & 1) * 4 + (y >> {bits - 1 - i} & 1) * 2 + (z >> {bits - 1 - i} & 1)"
        steps.append(f"a{i} AS (SELECT * EXCLUDE (s{i}, c{i}), s{i}, c{i}, {curve_table()}[s{i} * 8 + {cell} + 1] AS o{i} FROM {last})")
        last = f"(SELECT * EXCLUDE (s{i}, c{i}, o{i}), o{i} // 8 AS s{i + 1}, c{i} * 8 + o{i} % 8 AS c{i + 1} FROM a{i})"
    rank = lambda c: f"(SELECT {c}, (row_number() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER () AS v FROM (SELECT DISTINCT {c} FROM documents))"
    return f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN {0xEDB88320} ELSE 0 END)) AS c FROM range(256) r(i))),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM t),
d AS (SELECT doc_id, source, lang, strlen(t) + 1 AS size, md5(t) AS digest, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, (k.k)[(xor(a, x) & 255) + 1]))) AS crc FROM b, k),
z AS MATERIALIZED (SELECT doc_id, size, digest, crc, p.v AS x, q.v AS y, least(floor(ln(size) / ln(2) * {(1 << bits) // 32}), {(1 << bits) - 1})::BIGINT AS z
  FROM d JOIN {rank("source")} p ON p.source IS NOT DISTINCT FROM d.source JOIN {rank("lang")} q ON q.lang IS NOT DISTINCT FROM d.lang),
{", ".join(steps)},
r AS (SELECT *, row_number() OVER (ORDER BY c{bits}, digest, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM {last}),
u AS (SELECT *, ({shards} * (r + 1) - 1) // n AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (r - shard * n // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM u
"""


QUERIES = {"op9_hilbert": op9_hilbert}
ORACLES = {"op9_hilbert": oracle()}
