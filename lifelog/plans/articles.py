"""What the newsroom has to write and post next, and what happened to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import MAX_PUSH_FAILURES
from ..operators.joins import with_players, with_servers
from ..operators.ordered import ranked


def qualified_lives(lives: DataFrame, life_kills: DataFrame, seconds: int) -> DataFrame:
    """Lives that count by stored play time, PvP death, or a kill in their window."""
    scored = life_kills.select(F.col("life_id").alias("id")).distinct().withColumn(
        "__scored", F.lit(True)
    )
    flagged = lives.join(scored, "id", "left")
    keep = (
        F.coalesce(F.col("death_cause") == "pvp", F.lit(False))
        | (F.col("playtime_seconds") >= seconds)
        | F.col("__scored").isNotNull()
    )
    return flagged.where(keep).drop("__scored")


def obituary_targets(
    qualified: DataFrame,
    players: DataFrame,
    servers: DataFrame,
    articles: DataFrame,
    aliases: DataFrame,
    since: Column,
    *,
    max_attempts: int,
    limit: int | None = None,
) -> DataFrame:
    """Qualified deaths without a published or exhausted obituary under any label held;
    with ``limit`` the latest deaths first."""
    held = aliases.select("player_id", F.lower("gamertag").alias("label")).distinct()
    settled = articles.where(
        (F.col("kind") == "obituary")
        & ((F.col("status") == "published") | (F.col("attempts") >= max_attempts))
    ).select(F.lower("gamertag").alias("label"), "server_id", F.col("life_started_at").alias("started_at"))
    settled = settled.join(held, "label").select("server_id", "player_id", "started_at")
    due = qualified.where(F.col("ended_at").isNotNull() & (F.col("ended_at") >= since)).join(
        settled, ["server_id", "player_id", "started_at"], "left_anti"
    )
    rows = with_servers(with_players(due, players), servers).select(
        F.col("id").alias("life_id"), "server_id", "gamertag", "map", "slug", "life_number",
        F.col("started_at").alias("life_started_at"), "ended_at",
    )
    order = [F.col("ended_at").desc(), F.col("life_id").desc()]
    return rows if limit is None else ranked(rows, order, limit)


def syndication_targets(
    articles: DataFrame,
    syndications: DataFrame,
    channels: list[str],
    since: Column,
    *,
    max_attempts: int,
    limit: int | None = None,
) -> DataFrame:
    """Published obituaries not yet posted to each channel; with ``limit`` the oldest deaths first.

    The channel list is a handful of names, so it is exploded as an array literal.
    """
    if not channels:
        return articles.select("slug", "headline", "lede", F.lit("").alias("channel")).limit(0)
    rows = articles.where(
        (F.col("kind") == "obituary") & (F.col("status") == "published")
        & (F.col("death_at") > since) & F.col("slug").isNotNull()
        & F.col("headline").isNotNull() & F.col("lede").isNotNull()
    ).select(
        "slug", "headline", "lede", "death_at",
        F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"),
    )
    log = syndications.select("slug", "channel", "posted_at", "attempts")
    due = rows.join(log, ["slug", "channel"], "left").where(
        F.col("posted_at").isNull() & (F.coalesce("attempts", F.lit(0)) < max_attempts)
    )
    order = [F.col("death_at").asc(), F.col("channel").asc(), F.col("slug").asc()]
    due = due.select("slug", "headline", "lede", "channel", "death_at")
    return due if limit is None else ranked(due, order, limit)


def apply_outcomes(current: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Attempt bookkeeping after a run: upsert of (status or posting, attempts, last error).

    ``current(keys…, attempts, posted_at)``, ``outcomes(keys…, ok, at, error)``.
    """
    seen = outcomes.select(*keys, "ok", "at", "error")
    merged = current.join(seen, keys, "full_outer")
    attempted = F.col("ok").isNotNull()
    return merged.select(
        *keys,
        (F.coalesce("attempts", F.lit(0)) + attempted.cast("int")).alias("attempts"),
        F.when(F.col("ok"), F.col("at")).otherwise(F.col("posted_at")).alias("posted_at"),
        F.when(attempted & ~F.col("ok"), F.col("error")).alias("last_error"),
        attempted.alias("changed"),
    )


def record_push_failures(subscriptions: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Subscriptions with failures counted; the fifth one disables.  ``failures(id)``."""
    counted = failures.groupBy("id").agg(F.count("*").alias("n"))
    total = F.col("failure_count") + F.col("n")
    return subscriptions.join(counted, "id").select(
        "id", "user_id", total.cast("int").alias("failure_count"),
        F.when(total >= MAX_PUSH_FAILURES, now).otherwise(F.col("disabled_at")).alias("disabled_at"),
    )
