"""Cut lineage through Parquet tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: The paths staged in each open :func:`scope`, the innermost last.
_SCOPES: list[list[str]] = []


@functools.cache
def _own_dir() -> str:
    """A temporary folder of this process, deleted at its end."""
    path = tempfile.mkdtemp(prefix="roadloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, Spark within one process gets a temporary folder (its executors are threads of this
    machine); a cluster gets a folder in the warehouse, never a machine-local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext._jsc.sc().isLocal():
        return _own_dir()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def keep_path(path: str) -> None:
    """Count a path as staged in the open :func:`scope`, if there is one."""
    if _SCOPES:
        _SCOPES[-1].append(path)


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table replaces the lineage, so losing an executor later repeats nothing before it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    keep_path(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def staged_with(df: DataFrame, name: str = "step", **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`staged`, and aggregates of the rows that are observed while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both and never broadcasts one. Spark takes exploded rows for as few as
    there were before, and rows in files for as small as their compressed form, so that far more than its threshold
    may go to the driver."""
    return df.hint("merge")


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`staged`; nothing may read it afterwards."""
    path = getattr(df, "_staged_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end, the tables staged within, but those given to the function that it yields.

    What is built within must be written within, as it reads those tables."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(kept)
