"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.plans.staging import staged


def ranked(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """``df``, written, with each row's position (long, from 0) in ``order``.

    Rows are dealt by range and sorted within partitions, and their place in the partition is written beside them;
    then each partition's offset is added, from one count per partition, which are broadcast as a table. A column
    named ``out`` is replaced.
    """
    part, place, offset = "_part", "_place", "_before"
    while {part, place, offset} & {c.lower() for c in df.columns}:
        part, place, offset = "_" + part, "_" + place, "_" + offset
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.select("*", F.shiftrightunsigned(at, 33).alias(part), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)), "ranked")
    sizes, before, offsets = rows.groupBy(part).agg(F.count("*").alias("n")).collect(), 0, []
    for r in sorted(sizes, key=lambda r: r[part]):
        offsets.append((r[part], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, f"{part} long, {offset} long")
    out_row = (F.col(offset) + F.col(place)).cast("long").alias(out)
    return rows.join(F.broadcast(table), part).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()], out_row)
