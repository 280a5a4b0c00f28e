"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import lifelog

#: Words are runs without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where a lambda reads it.

    An alias from an earlier projection may be inlined into a lambda and then runs for each
    element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def unit(*parts: Column) -> Column:
    """A number in [0, 1) drawn from the hash of ``parts``; the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; they may not have it on their path."""
    context, folder = spark.sparkContext, Path(lifelog.__file__).parent
    if context.applicationId in _SHIPPED or not folder.is_dir():
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="lifelog-")) / "lifelog-package.zip"  # read by the driver only, which serves it
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(folder.rglob("*.py")):
            out.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(archive))


#: Bytes of an Arrow batch of texts: each task holds some batches whole, in the JVM and in its Python worker.
BATCH_BYTES = 4 << 20
_BATCH_BYTES, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless it has a bound of its own."""
    if spark.conf.get(_BATCH_BYTES) == _UNSET:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


#: Rows that a Python function gets at once.
SLICE_ROWS = 256


def map_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Apply ``function`` to slices of Arrow batches of ``df``; nothing is shuffled.

    Results leave slice by slice, so what they take beside the batch stays small.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                yield function(batch.iloc[at:at + SLICE_ROWS].reset_index(drop=True))

    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)
