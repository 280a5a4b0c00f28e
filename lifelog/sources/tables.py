"""Idempotent sinks, event reads after a cursor, table storage and label repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import duplicate_keys
from ..operators.ordered import first_by

RAW_LINE_KEY = ["file", "line_index"]
EVENT_KEY = ["server_id", "file_id", "line_index", "sub_index"]


def append_new(df: DataFrame, existing: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``df`` to append: one per key, none whose key exists.

    With ``order`` the smallest row of a key is kept, otherwise any of its identical copies.
    """
    fresh = first_by(df, keys, [F.col(order)]) if order else df.dropDuplicates(list(keys))
    return fresh.join(existing.select(*keys), list(keys), "left_anti").select(*df.columns)


def events_after(events: DataFrame, after: int, limit: int) -> DataFrame:
    """Next events behind a cursor, by id; filter and limit reach the scan."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def save_tables(tables: dict[str, DataFrame], path: str, partition: Sequence[str] = ()) -> None:
    """Write every table as Parquet, replacing what was there (full rebuild)."""
    for name, df in tables.items():
        columns = [c for c in partition if c in df.columns]
        df.write.mode("overwrite").partitionBy(*columns).parquet(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def label_collisions(players: DataFrame, links: DataFrame) -> DataFrame:
    """Case collisions that must be settled by hand before labels are repaired."""
    low = F.lower("gamertag").alias("label")
    verified = links.where(F.col("status") == "verified")
    none = F.lit(None).cast("string").alias("user_id")
    return (
        duplicate_keys(players, [low]).select(F.lit("players").alias("source"), none, "label", "copies")
        .unionByName(
            duplicate_keys(verified, [low]).select(
                F.lit("verified links").alias("source"), none, "label", "copies"
            )
        )
        .unionByName(
            duplicate_keys(links, ["user_id", low]).select(
                F.lit("links of one user").alias("source"), "user_id", "label", "copies"
            )
        )
    )


def canonicalize_labels(links: DataFrame, players: DataFrame) -> DataFrame:
    """Links whose label differs from the player's only by case, with the corrected label.

    Labels that collide in ``players`` are left alone; see :func:`label_collisions`.
    """
    names = players.groupBy(F.lower("gamertag").alias("label")).agg(
        F.min("gamertag").alias("canonical"), F.count("*").alias("n")
    ).where(F.col("n") == 1)
    return (
        links.withColumn("label", F.lower("gamertag")).join(names, "label")
        .where(F.col("gamertag") != F.col("canonical"))
        .select("id", "user_id", "gamertag", "canonical")
    )


def backfill_account_ids(bans: DataFrame, players: DataFrame) -> DataFrame:
    """Bans with the account hash of their label filled in where it is known."""
    known = players.where(F.col("dayz_id").isNotNull()).groupBy(F.lower("gamertag").alias("label")).agg(
        F.max_by("dayz_id", "last_seen_at").alias("known_id")
    )
    return (
        bans.withColumn("label", F.lower("gamertag")).join(known, "label", "left")
        .withColumn("dayz_id", F.coalesce("known_id", "dayz_id")).drop("label", "known_id")
    )
