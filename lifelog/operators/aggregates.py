"""Aggregations.  All are plain groupBy aggregates, so they combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_fire
from .temporal import islands


def kill_counts(kills: DataFrame, by: str = "id") -> DataFrame:
    """Kills per server and killer: by identity (unknown killers excluded) or by label."""
    if by == "id":
        kills = kills.where(F.col("killer_player_id").isNotNull())
        keys = ["server_id", "killer_player_id"]
    else:
        keys = ["server_id", "killer_gamertag"]
    return kills.groupBy(*keys).agg(F.count("*").alias("kills"))


def longest_kill(kills: DataFrame, keys: list[str]) -> DataFrame:
    return kills.groupBy(*keys).agg(F.max("distance").alias("longest_kill_meters"))


def balances(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """Balance of every user, 0 for users without ledger rows."""
    totals = ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))
    return (
        users.select("user_id").distinct().join(totals, "user_id", "left")
        .select("user_id", F.coalesce("balance", F.lit(0).cast("long")).alias("balance"))
    )


def verified_users(links: DataFrame) -> DataFrame:
    return links.where(F.col("status") == "verified").select("user_id").distinct()


def referral_counts(referrals: DataFrame, links: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct verified referees of each referrer.

    A referee has one referral row, so the distinct is taken over the small (referrer, referee)
    pairs; ``approximate`` swaps in a sketch.
    """
    pairs = referrals.join(verified_users(links), "user_id", "left_semi")
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return pairs.groupBy("referrer_user_id").agg(counter("user_id").alias("referees"))


def inbox_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("read_at").isNull()).alias("unread")
    )


def duplicate_keys(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def player_totals(per_server: DataFrame) -> DataFrame:
    """Totals of each player over all servers."""
    return per_server.groupBy("player_id").agg(
        F.sum("lives").alias("lives"),
        F.sum("deaths").alias("deaths"),
        F.sum("kills").alias("kills"),
        F.sum("total_playtime_seconds").alias("total_playtime_seconds"),
        F.max("longest_life_seconds").alias("longest_life_seconds"),
        F.bool_or("alive").alias("alive_anywhere"),
    )


def ordeal_category() -> Column:
    """Fire before attacker type; other environment hits belong to no ordeal."""
    return (
        F.when(is_fire(F.col("attacker_label")), "fire")
        .when(F.col("attacker_type") == "infected", "infected")
        .when(F.col("attacker_type") == "player", "pvp")
    )


def ordeal_summaries(hits_in_lives: DataFrame, gap_seconds: float) -> DataFrame:
    """Per life and ordeal: encounters, hits, and the hits of the worst encounter."""
    ticks = hits_in_lives.withColumn("ordeal", ordeal_category()).where(F.col("ordeal").isNotNull())
    ticks = ticks.select("life_id", "ordeal", "occurred_at", "event_id")
    runs = islands(ticks, ["life_id", "ordeal"], "occurred_at", "event_id", gap_seconds, "encounter")
    per_run = runs.groupBy("life_id", "ordeal", "encounter").agg(F.count("*").alias("n"))
    return per_run.groupBy("life_id", "ordeal").agg(
        F.count("*").alias("encounters"), F.sum("n").alias("hits"), F.max("n").alias("worst")
    )


def life_ordeals(
    lives: DataFrame,
    hits_in_lives: DataFrame,
    build_events: DataFrame,
    sessions: DataFrame,
    gap_seconds: float,
) -> DataFrame:
    """One row per life: ordeal counts, lowest hit points, builds and sessions."""
    wide = ordeal_summaries(hits_in_lives, gap_seconds).groupBy("life_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("ordeal") == o, F.col(c))), F.lit(0).cast("long")).alias(f"{o}_{c}")
            for o in ("fire", "infected", "pvp")
            for c in ("encounters", "hits", "worst")
        ]
    )
    low = hits_in_lives.groupBy("life_id").agg(F.min("victim_hp").alias("hp_low"))
    built = build_events.where(F.col("life_id").isNotNull()).groupBy("life_id").agg(
        F.count("*").alias("builds_placed")
    )
    logins = sessions.groupBy("life_id").agg(F.count("*").alias("session_count"))
    zero = [f"{o}_{c}" for o in ("fire", "infected", "pvp") for c in ("encounters", "hits", "worst")]
    return (
        lives.select(F.col("id").alias("life_id"))
        .join(wide, "life_id", "left")
        .join(low, "life_id", "left")
        .join(built, "life_id", "left")
        .join(logins, "life_id", "left")
        .fillna(0, [*zero, "builds_placed", "session_count"])
    )
