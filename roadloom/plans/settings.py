"""Users' settings as a Parquet table of changes, of which the latest counts."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.plans.config import DEFAULTS, PipelineConfig
from roadloom.plans.store import claimed

#: The columns of :class:`PipelineConfig`.
SETTINGS = (
    "max_speed_kmh double, cell_resolution int, k int, max_radius_m double, iterations int, grasp_alpha double, grasp_eval_budget int, country string, retain_percent double, buffer_m double, algorithm string"
)
_NAMES = [c.split()[0] for c in SETTINGS.split(", ")]


class StoredConfigs:
    """Settings by user under ``root``, which outlive the process. A user without own settings gets a copy of the
    defaults on first use, so that later defaults don't change what somebody has seen. Each change is a row with a
    claimed revision; writers at the same time never lose each other's."""

    def __init__(self, spark: SparkSession, root: str, default: PipelineConfig = DEFAULTS) -> None:
        self.spark, self.root, self._default = spark, root.rstrip("/"), default

    def _rows(self) -> DataFrame:
        schema = f"user_id long, revision long, {SETTINGS}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/settings")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/settings/*").select("user_id", "revision", *_NAMES)

    def latest(self) -> DataFrame:
        """One row for each user with own settings: user_id, revision and the settings."""
        last = self._rows().groupBy("user_id").agg(F.max_by(F.struct("revision", *_NAMES), "revision").alias("s"))
        return last.select("user_id", "s.*")

    def save(self, rows: DataFrame) -> None:
        """Add rows (user_id, revision and settings; the defaults where a column is missing or null, but country)."""
        known = {c.lower() for c in rows.columns}
        kinds = dict(c.split() for c in SETTINGS.split(", "))
        own = [(F.coalesce(F.col(n), F.lit(getattr(self._default, n))) if n in known and n != "country" else F.col(n) if n in known else F.lit(getattr(self._default, n))).cast(kinds[n]).alias(n) for n in _NAMES]
        rows.select(F.col("user_id").cast("long").alias("user_id"), F.col("revision").cast("long").alias("revision"), *own).write.parquet(f"{self.root}/settings/{uuid.uuid4().hex}")

    def _put(self, user: int, config: PipelineConfig, after: int) -> PipelineConfig:
        revision = claimed(self.spark, f"{self.root}/claims/settings-{user}", after)
        self.save(self.spark.createDataFrame([(user, revision, *[asdict(config)[n] for n in _NAMES])], f"user_id long, revision long, {SETTINGS}").coalesce(1))
        return config

    def _found(self, user: int) -> tuple[PipelineConfig | None, int]:
        row = self.latest().where(F.col("user_id") == user).first()
        return (None, -1) if row is None else (PipelineConfig(**{n: row[n] for n in _NAMES}), row["revision"])

    def active(self, user: int) -> PipelineConfig:
        config, _ = self._found(user)
        return config or self._put(user, self._default, -1)

    def update(self, user: int, **changes: object) -> PipelineConfig:
        config, revision = self._found(user)
        return self._put(user, (config or self._default).updated(**changes), revision)

    def reset(self, user: int) -> PipelineConfig:
        return self._put(user, self._default, self._found(user)[1])

    def of(self, users: DataFrame) -> DataFrame:
        """user_id and settings of each of ``users`` (user_id), the defaults for those without own ones; nothing is
        saved for them."""
        latest = self.latest().withColumn("own", F.lit(True))
        rows = users.select("user_id").join(latest, "user_id", "left")
        return rows.select("user_id", *[F.when(F.col("own"), F.col(n)).otherwise(F.lit(getattr(self._default, n))).alias(n) for n in _NAMES])
