"""Ban planning and ban state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import QUALIFY_SECONDS
from ..operators.filters import is_qualified
from ..operators.joins import kill_summary, unbanned_lives


def qualified_by(death_cause: Column, kills: Column) -> Column:
    """Why a qualified life qualified: pvp-death before kill before playtime."""
    return (
        F.when(death_cause == "pvp", "pvp-death").when(kills > 0, "kill").otherwise("playtime")
    )


def plan_bans(
    lives: DataFrame,
    players: DataFrame,
    bans: DataFrame,
    label_kills: DataFrame,
    hours: float,
    *,
    seconds: int = QUALIFY_SECONDS,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Bans to append: ended, unbanned, qualified lives.

    ``label_kills`` are the (life, kill) pairs matched by label
    (:func:`lifelog.operators.joins.life_kills` with ``by="label"``).
    """
    kills = kill_summary(label_kills).select(F.col("life_id").alias("id"), "kills")
    rows = unbanned_lives(lives, players, bans, aliases).join(kills, "id", "left")
    due = rows.where(
        is_qualified(F.col("death_cause"), F.col("kills"), F.col("playtime_seconds"), seconds)
    )
    span = int(hours * 3_600_000_000)
    return due.select(
        "server_id", "gamertag", "dayz_id", F.col("started_at").alias("life_started_at"),
        F.lit("qualified_death").alias("reason"),
        qualified_by(F.col("death_cause"), F.col("kills")).alias("qualified_by"),
        F.col("ended_at").alias("banned_at"),
        F.timestamp_micros(F.unix_micros("ended_at") + span).alias("expires_at"),
        F.lit("pending").alias("status"),
    )


def ban_transitions(bans: DataFrame, now: Column) -> DataFrame:
    """Rows whose status moves now: pending -> applied, due applied -> expired,
    lift_pending -> lifted.  One step per run, as the list on the game host must follow."""
    moved = (
        F.when(F.col("status") == "pending", "applied")
        .when((F.col("status") == "applied") & (F.col("expires_at") <= now), "expired")
        .when(F.col("status") == "lift_pending", "lifted")
    )
    out = bans.withColumn("new_status", moved).where(F.col("new_status").isNotNull())
    leaves = F.col("new_status").isin("expired", "lifted")
    return out.select(
        F.col("id").alias("ban_id"), "server_id", "gamertag", "dayz_id", "status", "new_status",
        F.when(F.col("new_status") == "applied", now).alias("applied_at"),
        F.when(leaves, now).alias("lifted_at"),
    )
