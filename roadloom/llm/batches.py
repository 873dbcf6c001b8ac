"""Arrow batches in tasks: bounded sizes, one column in, columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bounds of an Arrow batch that goes to a Python worker.
ROWS, BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within :data:`ROWS` rows and about :data:`BYTES` bytes, for texts of any length."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BYTES}b")


def add_columns(df: DataFrame, source: str, fields: list[T.StructField], make: Callable[..., list[pa.Array]], arrow: bool = False) -> DataFrame:
    """``df`` with ``fields``, which ``make`` computes batch by batch from the values of column ``source``.

    Columns of ``df`` with those names are replaced; all others pass through unchanged, whatever they are called.
    ``make`` gets a list of Python values (the Arrow array itself if ``arrow``) and returns an Arrow array per field.
    """
    new = {f.name.lower() for f in fields}
    names = [c for c in df.columns if c.lower() not in new or c == source]
    kept = [i for i, c in enumerate(names) if c.lower() not in new]
    at = names.index(source)
    bound_batches(df.sparkSession)
    slim = df.select(*[df[f"`{c}`"] for c in names])
    schema = T.StructType([slim.schema.fields[i] for i in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b.column(at) if arrow else b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + made, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
