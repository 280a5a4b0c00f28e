"""Unions with de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import first_by


def union_first(streams: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of streams; of rows with one key the row of the earliest stream is kept.

    Rows of one stream that share a key are ranked by their whole content, so the choice does not
    depend on partitioning.
    """
    tagged = [df.withColumn("__stream", F.lit(i)) for i, df in enumerate(streams)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [F.col(c) for c in merged.columns if c not in (*keys, "__stream")]
    return first_by(merged, keys, [F.col("__stream"), *rest]).drop("__stream")


def new_notifications(streams: Sequence[DataFrame], existing: DataFrame) -> DataFrame:
    """Drafts of all generators, first per natural key, minus those already stored."""
    return union_first(streams, ["natural_key"]).join(
        existing.select("natural_key"), "natural_key", "left_anti"
    )


def union_all(streams: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), streams)
