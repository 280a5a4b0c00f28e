"""Tables as rows by version, made visible by one pointer row.

Every batch writes its rows under its own version: new and changed rows, and marks for rows that are no
longer true.  Nothing is overwritten, so readers of an older version are not disturbed.  When all
tables of a version are written, one row in ``published`` names it; a reader that follows the pointer
sees all tables of one version or of the one before, never a mix.  A batch that failed half-way is
written again under the same version.

The current rows of a table are, for each key, those of the latest version up to the pointer.  Small
tables that every batch reads are gathered into one base now and then, so what a batch reads does not
grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "__gone"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored table, or None before its first row."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # Missing folder, or a folder without data files.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class Pointer:
    """``version`` is readable, ``base`` was gathered last, ``high`` is the highest event id so far."""

    version: int = -1
    base: int = -1
    high: int = -1


class Versions:
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def pointer(self, spark: SparkSession) -> Pointer:
        rows = read_table(spark, f"{self.root}/published")
        if rows is None:
            return Pointer()
        # One row for each version; the latest decides.
        last = rows.agg(F.max(F.struct("version", "base", "high")).alias("p")).first()["p"]
        return Pointer(last["version"], last["base"], last["high"])

    def publish(self, spark: SparkSession, pointer: Pointer) -> None:
        row = spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in vars(pointer).items()])
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/published")

    def write(self, df: DataFrame, name: str, version: int, partition: Sequence[str] = ()) -> None:
        """Rows of a version; the column ``GONE`` marks keys without a row from now on."""
        rows = df if GONE in df.columns else df.withColumn(GONE, F.lit(False))
        rows.write.mode("overwrite").partitionBy(*partition).parquet(f"{self.root}/{name}/version={version}")

    def rows(self, spark: SparkSession, name: str, at: Pointer) -> DataFrame | None:
        """All rows of the versions up to ``at``, with ``version``."""
        stored = read_table(spark, f"{self.root}/{name}")
        return None if stored is None else stored.where(F.col("version") <= at.version)

    def current(self, spark: SparkSession, name: str, keys: Sequence[str], at: Pointer, only=None) -> DataFrame | None:
        """Current rows; ``only`` narrows the rows by their keys before the latest are chosen."""
        stored = self.rows(spark, name, at)
        base = read_table(spark, f"{self.root}/{name}-base/version={at.base}") if at.base >= 0 else None
        if base is not None:
            newer = stored.where(F.col("version") > at.base)
            stored = newer.unionByName(base.withColumns({"version": F.lit(at.base), GONE: F.lit(False)}).select(*newer.columns))
        if stored is None:
            return None
        if only is not None:
            stored = only(stored)
        rest = [c for c in stored.columns if c not in (*keys, "version")]
        latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("__row"))
        return latest.select(*keys, "__row.*").where(~F.col(GONE)).drop(GONE)

    def gather(self, spark: SparkSession, name: str, keys: Sequence[str], at: Pointer) -> None:
        """Write the current rows as one table, to be read instead of the versions so far."""
        rows = self.current(spark, name, keys, at)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}-base/version={at.version}")
