"""Wallets, inboxes and label links of every account."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import INBOX_PAGE_SIZE, WALLET_ROWS
from ..functions.scalars import emote_label, instant
from ..operators.aggregates import inbox_counts
from ..operators.ordered import latest_by, top_per_key


def wallet(ledger: DataFrame, rows: int = WALLET_ROWS) -> DataFrame:
    """Balance and the newest ``rows`` ledger entries of each user."""
    totals = ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))
    newest = top_per_key(
        ledger.select("user_id", "id", "delta", "kind", "created_at"), ["user_id"],
        [F.col("id").desc()], rows,
    )
    return newest.join(totals, "user_id")


def inbox(notifications: DataFrame, page: int = 1, size: int = INBOX_PAGE_SIZE) -> DataFrame:
    """One page of each user's notifications with the total and unread counts."""
    page = max(1, page)
    rows = top_per_key(
        notifications.select("user_id", "id", "kind", "title", "body", "href", "created_at", "read_at"),
        ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], page * size,
    ).where(F.col("rank") > (page - 1) * size)
    return rows.join(inbox_counts(notifications), "user_id")


def links_with_challenge(links: DataFrame, challenges: DataFrame, now: datetime) -> DataFrame:
    """Links of all users; pending ones carry their newest challenge with readable emotes."""
    newest = latest_by(
        challenges, ["gamertag_link_id"], [F.col("issued_at"), F.col("id")]
    ).select(
        F.col("gamertag_link_id").alias("id"),
        F.transform("sequence", lambda t: F.coalesce(emote_label(t), t)).alias("steps"),
        "progress_index", "expires_at", (instant(now) > F.col("expires_at")).alias("expired"),
    )
    pending = newest.join(
        links.where(F.col("status") == "pending").select("id"), "id", "left_semi"
    )
    return links.select("id", "user_id", "gamertag", "status", "verified_at").join(pending, "id", "left")
