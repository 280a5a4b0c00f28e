"""De-duplication of a stream on its idempotency key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sources.tables import append_new
from .versions import read_table


def dedupe_stream(df: DataFrame, keys: Sequence[str], at: str = "occurred_at", lateness: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within ``lateness`` of each other; state is bounded."""
    return df.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def append_once(path: str, keys: Sequence[str], partition: Sequence[str] = ()):
    """``foreachBatch`` sink that appends only keys not stored yet, over the whole history.

    A batch that is replayed after a failure finds its own rows and adds nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        stored = read_table(batch.sparkSession, path)
        fresh = batch.dropDuplicates(list(keys)) if stored is None else append_new(batch, stored, keys)
        fresh.write.mode("append").partitionBy(*partition).parquet(path)

    return sink
