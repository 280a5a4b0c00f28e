"""Token grants and purchases as keyed rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import MAX_PURCHASE_QUANTITY
from ..operators.aggregates import verified_users
from ..operators.sets import union_first

#: Keys of purchased tokens: session and number of the token, as ``expand_purchases`` writes them.
_TOKEN_KEY = r"(?s)\Astripe:(.*):([1-9][0-9]{0,8})\z"


def plan_grants(links: DataFrame, referrals: DataFrame, ledger: DataFrame, month: str) -> DataFrame:
    """Grants not yet in the ledger: one per verified link, one per user and month, one per
    verified referee ever.  ``month`` is ``YYYY-MM``."""
    verified = links.where(F.col("status") == "verified")
    users = verified_users(links)
    per_link = verified.select(
        "user_id", F.lit("verification").alias("kind"),
        F.concat(F.lit("verify:"), F.col("id").cast("string")).alias("idempotency_key"),
    )
    monthly = users.select(
        "user_id", F.lit("monthly").alias("kind"),
        F.concat(F.lit("monthly:"), F.col("user_id"), F.lit(f":{month}")).alias("idempotency_key"),
    )
    referees = referrals.join(users, "user_id", "left_semi").select(
        F.col("referrer_user_id").alias("__to"), "user_id"
    )
    referral = referees.select(
        F.col("__to").alias("user_id"), F.lit("referral").alias("kind"),
        F.concat(F.lit("referral:"), F.col("__to"), F.lit(":"), F.col("user_id")).alias("idempotency_key"),
    )
    fresh = union_first([per_link, monthly, referral], ["idempotency_key"]).join(
        ledger.select("idempotency_key"), "idempotency_key", "left_anti"
    )
    return fresh.select("user_id", F.lit(1).alias("delta"), "kind", "idempotency_key")


def expand_purchases(purchases: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants, refused): one keyed ledger row per purchased token, and the purchases whose
    quantity is null or outside 1..100, which grant nothing.

    ``purchases(session_id, user_id, quantity)``.
    """
    sound = F.coalesce(F.col("quantity").between(1, MAX_PURCHASE_QUANTITY), F.lit(False))
    valid, refused = purchases.where(sound), purchases.where(~sound)
    # A session's keys are its tokens 1..quantity, so sessions are told apart and compared with the ledger
    # before they become tokens: of a repeated session the largest purchase counts.
    session = F.col("session_id").cast("string")
    bought = valid.groupBy(session.alias("session")).agg(
        F.max(F.struct(F.col("quantity").cast("int").alias("quantity"), "user_id")).alias("p")
    )
    told = ledger.select(
        F.regexp_extract("idempotency_key", _TOKEN_KEY, 1).alias("session"),
        F.regexp_extract("idempotency_key", _TOKEN_KEY, 2).cast("int").alias("n"),
        F.col("idempotency_key").rlike(_TOKEN_KEY).alias("is_token"),
    ).where("is_token")
    granted = told.where(F.col("n") <= MAX_PURCHASE_QUANTITY).groupBy("session").agg(
        F.collect_set("n").alias("granted")
    )
    # Purchases without a session share one key, which is null.
    tokens = F.sequence(F.lit(1), F.when(F.col("session").isNull(), 1).otherwise(F.col("p.quantity")))
    due = F.array_except(tokens, F.coalesce("granted", F.array().cast("array<int>")))
    grants = bought.join(granted, "session", "left").select(
        F.col("p.user_id").alias("user_id"), "session", F.explode(due).alias("n")
    ).select(
        "user_id", F.lit(1).alias("delta"), F.lit("purchase").alias("kind"),
        F.concat(F.lit("stripe:"), F.col("session"), F.lit(":"), F.col("n").cast("string")).alias("idempotency_key"),
    )
    return grants, refused.select("session_id", "user_id", "quantity")
