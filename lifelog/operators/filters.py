"""Predicates and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import QUALIFY_SECONDS


def is_qualified(
    death_cause: Column, kills_in_window: Column, playtime: Column, seconds: int = QUALIFY_SECONDS
) -> Column:
    """A life counts when it ended in PvP, saw a kill, or lasted ``seconds`` of play time."""
    return (
        F.coalesce(death_cause == "pvp", F.lit(False))
        | F.coalesce(kills_in_window > 0, F.lit(False))
        | F.coalesce(playtime >= seconds, F.lit(False))
    )


def live_servers(servers: DataFrame) -> DataFrame:
    return servers.where(F.col("active") & F.col("slug").isNotNull())


def search_labels(df: DataFrame, prefix: str, n: int, column: str = "gamertag") -> DataFrame:
    """First ``n`` labels with a case-insensitive prefix; ``%`` and ``_`` act as wildcards.

    Prefixes under two characters return nothing.
    """
    if len(prefix) < 2:
        return df.select(column).limit(0)
    return df.where(F.col(column).ilike(f"{prefix}%")).select(column).orderBy(column).limit(n)


def window_start(since: Column, now: Column, lookback_hours: float) -> Column:
    """Start of the candidate window; a null ``since`` means the feature is off (null)."""
    lookback = F.timestamp_micros(F.unix_micros(now) - int(lookback_hours * 3_600_000_000))
    return F.when(since.isNotNull(), F.greatest(since, lookback))


def same_label(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def due_expiries(bans: DataFrame, now: Column) -> DataFrame:
    return bans.where((F.col("status") == "applied") & (F.col("expires_at") <= now))


def fresh(at: Column, now: Column, seconds: float) -> Column:
    return at >= F.timestamp_micros(F.unix_micros(now) - int(seconds * 1_000_000))
