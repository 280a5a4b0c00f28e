"""Notification drafts and the delivery plan.

Every generator returns (user_id, kind, natural_key, title, body, href); the natural key makes a
draft idempotent.  ``lifelog.operators.sets.new_notifications`` merges generators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import MILESTONE_DAYS
from ..functions.scalars import slug
from ..operators.windows import qualified_at
from ..queries.dataset import Dataset

# Wording of token grants by kind.
GRANT_BODY = {
    "monthly": "Your monthly unban token landed.",
    "referral": "A referral paid out — one unban token.",
    "verification": "Verification bonus — one unban token.",
}


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _draft(df: DataFrame, kind: str | Column, key: Column, title, body: Column, href: Column) -> DataFrame:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        "user_id", as_column(kind).alias("kind"), key.alias("natural_key"),
        as_column(title).alias("title"), as_column(body).alias("body"), as_column(href).alias("href"),
    )


def _owned_bans(d: Dataset) -> DataFrame:
    """Real bans with the verified owner of the label and the server name."""
    owner = d["gamertag_links"].where(F.col("status") == "verified").select(
        F.lower("gamertag").alias("label"), "user_id", F.col("gamertag").alias("owner_tag")
    )
    names = d["servers"].select(F.col("id").alias("server_id"), F.col("name").alias("server_name"))
    real = d["bans"].where(~F.col("dry_run")).withColumn("label", F.lower("gamertag"))
    return real.join(owner, "label").join(names, "server_id")


def draft_ban_applied(d: Dataset, start: Column) -> DataFrame:
    rows = _owned_bans(d).where(F.col("created_at") >= start)
    return _draft(
        rows, "ban_applied", _text("ban_applied:", F.col("id")), "You died on a qualified life",
        _text(F.col("server_name"), ": banned for 24 hours. Spend an unban token to come back early."),
        _text("/players/", slug(F.col("owner_tag"))),
    )


def draft_ban_lifted(d: Dataset, start: Column) -> DataFrame:
    rows = _owned_bans(d).where(
        F.col("status").isin("expired", "lifted") & (F.col("lifted_at") >= start)
    )
    body = F.when(
        F.col("status") == "lifted",
        _text(F.col("server_name"), ": your token was spent and the ban is lifted."),
    ).otherwise(_text(F.col("server_name"), ": your ban has expired. Go start a new life."))
    return _draft(
        rows, "ban_lifted", _text("ban_lifted:", F.col("id")), "You're back in", body,
        _text("/players/", slug(F.col("owner_tag"))),
    )


def open_qualified_lives(d: Dataset) -> DataFrame:
    """Open qualified lives of verified users on slugged servers, kills matched by link label."""
    owner = d["gamertag_links"].where(F.col("status") == "verified").select(
        F.lower("gamertag").alias("label"), "user_id", F.col("gamertag").alias("owner_tag")
    )
    places = d["servers"].where(F.col("slug").isNotNull()).select(
        F.col("id").alias("server_id"), F.col("name").alias("server_name"), "slug"
    )
    rows = (
        d.lives_of.where(F.col("ended_at").isNull())
        .withColumn("label", F.lower("gamertag"))
        .join(owner, "label").join(places, "server_id")
    )
    # A player has one open life per server, so label and server find it without a range join.
    kills = (
        d["kills"].select("server_id", F.lower("killer_gamertag").alias("label"), "occurred_at")
        .join(rows.select("server_id", "label", F.col("id").alias("life_id"), "started_at"),
              ["server_id", "label"])
        .where(F.col("occurred_at") >= F.col("started_at"))
    )
    open_ids = rows.select(F.col("id").alias("life_id")).distinct()
    when = qualified_at(
        rows.select("id", "death_cause", "ended_at"),
        d["sessions"].join(open_ids, "life_id", "left_semi"),
        kills, d.last_seen, d.qualify_seconds,
    )
    return rows.join(when.withColumnRenamed("life_id", "id"), "id")


def _life_href() -> Column:
    return _text("/players/", slug(F.col("owner_tag")), "/", F.col("slug"), "/lives/", F.col("life_number"))


def draft_life_qualified(d: Dataset, start: Column) -> DataFrame:
    rows = open_qualified_lives(d).where(F.col("qualified_at") >= start)
    return _draft(
        rows, "life_qualified", _text("life_qualified:", F.col("id")), "This life counts now",
        _text(F.col("server_name"), ": life ", F.col("life_number"),
              " is qualified. Dying costs you 24 hours."),
        _life_href(),
    )


def draft_milestones(d: Dataset, start: Column) -> DataFrame:
    days = F.explode(F.array(*[F.lit(n) for n in MILESTONE_DAYS]))
    rows = open_qualified_lives(d).withColumn("days", days)
    crossed = F.timestamp_micros(
        F.unix_micros("started_at") + F.col("days").cast("long") * F.lit(86_400_000_000)
    )
    rows = rows.withColumn("crossed", crossed).where(
        (F.col("crossed") <= d.now) & (F.col("crossed") >= start)
    )
    return _draft(
        rows, "survival_milestone", _text("milestone:", F.col("days"), "d:", F.col("id")),
        _text(F.col("days"), " days alive"),
        _text(F.col("server_name"), ": life ", F.col("life_number"), " has survived ",
              F.col("days"), " days."),
        _life_href(),
    )


def draft_account(links: DataFrame, ledger: DataFrame, start: Column) -> DataFrame:
    """Label verified, and tokens granted or received."""
    verified = links.where((F.col("status") == "verified") & (F.col("verified_at") >= start))
    labels = _draft(
        verified, "gamertag_verified", _text("gamertag_verified:", F.col("id")), "Gamertag verified",
        _text(F.col("gamertag"), " is yours. Your lives are now tracked."),
        _text("/players/", slug(F.col("gamertag"))),
    )
    rows = ledger.where(
        (F.col("created_at") >= start) & F.col("kind").isin(*GRANT_BODY, "transfer_in")
    )
    received = F.col("kind") == "transfer_in"
    body = F.when(received, "Another survivor sent you an unban token.")
    for kind, text in GRANT_BODY.items():
        body = body.when(F.col("kind") == kind, text)
    tokens = _draft(
        rows, F.when(received, "tokens_received").otherwise("tokens_granted"),
        _text("tokens:", F.col("id")),
        F.when(received, "Token received").otherwise("Token granted"), body, F.lit("/"),
    )
    return labels.unionByName(tokens)


def draft_location_shared(d: Dataset) -> DataFrame:
    """One draft per grant; the key carries the session start, so a new session notifies again."""
    tags = d["gamertag_links"].where(F.col("status") == "verified").select(
        F.col("user_id").alias("granter_user_id"), "gamertag"
    )
    places = d["servers"].where(F.col("slug").isNotNull()).select(
        F.col("id").alias("server_id"), "slug", "name"
    )
    rows = (
        d["location_shares"].join(tags, "granter_user_id").join(places, "server_id")
        .withColumn("user_id", F.col("grantee_user_id"))
    )
    instant = F.date_format("granter_session_connected_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _draft(
        rows, "location_shared",
        _text("location_shared:", F.col("grantee_user_id"), ":", F.col("gamertag"), ":", instant),
        _text(F.col("gamertag"), " shared their position"),
        _text("You can see them on ", F.col("name"), " until they log out."),
        _text("/maps/", F.col("slug")),
    )


def plan_push(
    notifications: DataFrame, subscriptions: DataFrame, now: Column, max_age_minutes: float
) -> DataFrame:
    """Unpushed notifications with what to do: send to each active subscription, or skip when too
    old or without one.  Sending itself is not part of the plan."""
    active = subscriptions.where(F.col("disabled_at").isNull()).select(
        "user_id", F.col("id").alias("subscription_id"), "endpoint"
    )
    cutoff = F.timestamp_micros(F.unix_micros(now) - int(max_age_minutes * 60_000_000))
    waiting = notifications.where(F.col("pushed_at").isNull()).withColumn(
        "stale", F.col("created_at") < cutoff
    )
    old = waiting.where("stale").select("id", "user_id", F.lit("skip_old").alias("action"))
    fresh = waiting.where(~F.col("stale")).join(active, "user_id", "left")
    fresh = fresh.select(
        "id", "user_id",
        F.when(F.col("subscription_id").isNull(), "skip_none").otherwise("send").alias("action"),
        "subscription_id", "endpoint", "title", "body", "href",
    )
    return fresh.unionByName(old, allowMissingColumns=True)
