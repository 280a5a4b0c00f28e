"""Encounters and presence as session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ENCOUNTER_GAP_SECONDS, FRESH_SECONDS


def stream_encounters(
    hits: DataFrame,
    keys: list[str],
    gap_seconds: int = ENCOUNTER_GAP_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Encounter spans per key in append mode; a hit exactly ``gap_seconds`` later still joins.

    Works on a stream and on a batch table alike.
    """
    marked = hits.withWatermark("occurred_at", lateness) if hits.isStreaming else hits
    spans = marked.groupBy(*keys, F.session_window("occurred_at", f"{gap_seconds} seconds").alias("w")).agg(
        F.count("*").alias("hits"), F.min("victim_hp").alias("hp_low"),
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_at"),
    )
    return spans.select(*keys, "started_at", "last_at", "hits", "hp_low")


def presence_spans(evidence: DataFrame, seconds: int = FRESH_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Spans of uninterrupted presence per (server, player): evidence at most ``seconds`` apart.

    ``expires_at`` is the instant the player stops counting as present.
    """
    marked = evidence.withWatermark("occurred_at", lateness) if evidence.isStreaming else evidence
    spans = marked.groupBy(
        "server_id", "player_id", F.session_window("occurred_at", f"{seconds} seconds").alias("w")
    ).agg(F.min("occurred_at").alias("seen_from"), F.max("occurred_at").alias("seen_to"))
    return spans.select("server_id", "player_id", "seen_from", "seen_to", F.col("w.end").alias("expires_at"))


def stream_presence(resolved: DataFrame, seconds: int = FRESH_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Presence spans from resolved connect and position events."""
    evidence = resolved.where(
        F.col("type").isin("player.connected", "player.position") & F.col("player_id").isNotNull()
    )
    return presence_spans(evidence, seconds, lateness)
