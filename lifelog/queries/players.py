"""Player profiles, pages and priors, computed for all players at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import PAST_LIVES_PAGE_SIZE
from ..functions.scalars import cause_family
from ..operators.aggregates import kill_counts, player_totals
from ..operators.filters import live_servers
from ..operators.joins import LIFE_KEYS, filed_obituaries
from ..operators.ordered import latest_by, max_before, ordered_scan, running_sum, time_slice
from ..operators.paging import clamp_page
from ..operators.temporal import asof_join
from .dataset import Dataset

ACTIVE_BANS = ["applied", "pending", "lift_pending"]


def profiles(d: Dataset) -> DataFrame:
    """Per server and player with any life there: figures over the qualified lives."""
    rows = d.life_status
    q = F.col("qualified")
    open_ = q & F.col("ended_at").isNull()
    return rows.groupBy(*LIFE_KEYS, "gamertag", "last_seen_at").agg(
        F.count_if(q).alias("lives"),
        F.count_if(q & F.col("ended_at").isNotNull()).alias("deaths"),
        F.coalesce(F.sum(F.when(q, F.col("seconds"))), F.lit(0).cast("long")).alias("total_playtime_seconds"),
        F.coalesce(F.max(F.when(open_, F.col("seconds"))), F.lit(0).cast("long")).alias("current_life_seconds"),
        F.coalesce(F.bool_or(open_), F.lit(False)).alias("alive"),
        F.coalesce(F.max(F.when(q, F.col("playtime_seconds"))), F.lit(0).cast("long"))
        .alias("longest_life_seconds"),
    )


def player_lives(d: Dataset) -> DataFrame:
    """Qualified lives, newest number first within server and player when ordered so."""
    return d.life_status.where("qualified")


def life_detail(d: Dataset) -> DataFrame:
    """Every life with its sessions, one row per session in ``connected_at`` order when sorted.

    Flat on purpose: a life may hold any number of sessions, so they are never gathered into one
    array.
    """
    logs = d["sessions"].select(
        F.col("life_id").alias("id"), F.col("id").alias("session_id"), "connected_at",
        "disconnected_at", "duration_seconds", "close_reason",
    )
    return d.lives_of.join(logs, "id", "left")


def player_servers(d: Dataset) -> DataFrame:
    """Profile, kills and longest life per player and live server."""
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    kills = kill_counts(d["kills"]).withColumnRenamed("killer_player_id", "player_id")
    return (
        profiles(d).join(servers, "server_id")
        .join(kills, LIFE_KEYS, "left")
        .fillna(0, ["kills"])
    )


def player_aggregate(d: Dataset) -> DataFrame:
    """Totals of each player over the live servers."""
    names = d["players"].select(F.col("id").alias("player_id"), "gamertag")
    return player_totals(player_servers(d)).join(names, "player_id")


def standings(d: Dataset) -> DataFrame:
    """State of every (player, live server) with history or a ban: banned > alive > idle.

    A ban counts when it is real, active and carries the player's current label; the life it
    punishes is found by start instant among the qualified lives.
    """
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    status = d.life_status
    bans = d["bans"].where(F.col("status").isin(ACTIVE_BANS) & ~F.col("dry_run"))
    names = d["players"].select(F.col("id").alias("player_id"), "gamertag")
    banned = latest_by(
        bans.join(names, "gamertag").select(
            *LIFE_KEYS, F.col("id").alias("ban_id"), "banned_at", "expires_at", "life_started_at",
            (F.col("status") == "lift_pending").alias("lift_pending"),
        ),
        LIFE_KEYS, [-F.col("ban_id")],
    )
    trigger = status.where("qualified").select(
        *LIFE_KEYS, F.col("started_at").alias("life_started_at"),
        F.col("life_number").alias("triggering_life_number"), F.col("id").alias("trigger_life_id"),
    )
    verdicts = d.verdicts.select(
        F.col("life_id").alias("trigger_life_id"), F.col("verdict").alias("ban_verdict")
    )
    banned = banned.join(trigger, [*LIFE_KEYS, "life_started_at"], "left").join(
        verdicts, "trigger_life_id", "left"
    )
    open_ = latest_by(
        status.where(F.col("ended_at").isNull()).select(
            *LIFE_KEYS, F.col("id").alias("life_id"), "life_number", F.col("started_at").alias("alive_since"),
            F.col("seconds").alias("time_alive_seconds"), "kills", "longest_kill_meters",
        ),
        LIFE_KEYS, [F.col("life_number")],
    )
    qualified = d.qualified_at.select("life_id", "qualified_at", "qualified_by")
    open_ = open_.join(qualified, "life_id", "left")
    recent = status.where("qualified").groupBy(*LIFE_KEYS).agg(
        F.max("life_number").alias("recent_number"),
        F.max_by("ended_at", "life_number").alias("recent_ended_at"),
    )
    keys = (
        status.select(*LIFE_KEYS).unionByName(banned.select(*LIFE_KEYS)).distinct()
    )
    rows = (
        keys.join(servers, "server_id")
        .join(banned, LIFE_KEYS, "left")
        .join(open_, LIFE_KEYS, "left")
        .join(recent, LIFE_KEYS, "left")
        .join(names, "player_id")
    )
    is_banned, is_alive = F.col("ban_id").isNotNull(), F.col("life_id").isNotNull()
    state = F.when(is_banned, "banned").when(is_alive, "alive").otherwise("idle")
    only_alive = ~is_banned & is_alive
    only_idle = ~is_banned & ~is_alive
    return rows.select(
        *LIFE_KEYS, "gamertag", "map", "slug", state.alias("state"),
        F.when(only_alive, F.col("life_number")).alias("alive_life_number"),
        F.when(only_alive, F.col("time_alive_seconds")).alias("time_alive_seconds"),
        F.when(only_alive, F.col("kills")).alias("kills"),
        F.when(only_alive, F.col("longest_kill_meters")).alias("longest_kill_meters"),
        F.when(only_alive, F.col("qualified_at").isNotNull()).alias("qualified"),
        F.when(only_alive, F.col("qualified_at")).alias("qualified_at"),
        "ban_id", "banned_at", "expires_at", "lift_pending", "triggering_life_number",
        F.col("ban_verdict.cause").alias("ban_cause"),
        F.when(is_banned, F.col("triggering_life_number"))
        .when(is_alive, F.col("life_number"))
        .otherwise(F.col("recent_number")).alias("last_life_number"),
        F.when(only_idle, F.col("recent_ended_at")).alias("last_ended_at"),
    )


def server_cards(d: Dataset, viewers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, servers): the standings of the viewing players, and the list of live servers.

    A page shows every live server; one without a card of the player is idle.  The grid of players
    and servers is never made.
    """
    known = standings(d).select(
        *LIFE_KEYS, "map", "slug", "state", "last_life_number", "time_alive_seconds", "ban_id"
    )
    cards = known.join(viewers.select("player_id").distinct(), "player_id", "left_semi")
    return cards, live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")


def page_totals(d: Dataset) -> DataFrame:
    """Head of the player page: totals, previous best, alive flag, over live servers."""
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"))
    rows = d.life_status.join(servers, "server_id")
    q, ended = F.col("qualified"), F.col("ended_at").isNotNull()
    alive = (
        standings(d).where(F.col("state") == "alive")
        .groupBy("player_id").agg(F.bool_or("qualified").alias("alive_anywhere"))
    )
    kills = (
        kill_counts(d["kills"]).join(servers, "server_id")
        .groupBy(F.col("killer_player_id").alias("player_id")).agg(F.sum("kills").alias("kills"))
    )
    totals = rows.groupBy("player_id", "gamertag", "first_seen_at").agg(
        F.count_if(q).alias("lives"),
        F.count_if(q & ended).alias("deaths"),
        F.coalesce(F.max(F.when(q, F.col("seconds"))), F.lit(0).cast("long")).alias("longest_life_seconds"),
        F.coalesce(F.max(F.when(q & ended, F.col("playtime_seconds"))), F.lit(0).cast("long"))
        .alias("previous_best_seconds"),
    )
    verified = (
        d["gamertag_links"].where(F.col("status") == "verified")
        .select(F.lower("gamertag").alias("label"))
        .join(_identity_names(d), "label").select("player_id").distinct()
        .withColumn("verified", F.lit(True))
    )
    return (
        totals.join(kills, "player_id", "left")
        .join(alive, "player_id", "left")
        .join(verified, "player_id", "left")
        .fillna(0, ["kills"])
        .fillna(False, ["alive_anywhere", "verified"])
    )


def _identity_names(d: Dataset) -> DataFrame:
    names = d["players"].select(F.col("id").alias("player_id"), F.lower("gamertag").alias("label"))
    past = d["player_gamertags"].select("player_id", F.lower("gamertag").alias("label"))
    return names.unionByName(past).distinct()


def past_lives(d: Dataset, page: int = 1, size: int = PAST_LIVES_PAGE_SIZE) -> DataFrame:
    """One page of each player's ended qualified lives, newest death first, with verdicts.

    The requested page is clamped to the player's last page.  ``position`` is a running count
    over time slices, so a player with very many lives does not end up in one task.
    """
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    ended = d.life_status.where(F.col("qualified") & F.col("ended_at").isNotNull()).join(
        servers, "server_id"
    )
    totals = ended.groupBy("player_id").agg(F.count("*").alias("total"))
    one = F.lit(1).cast("long")
    rows = ordered_scan(
        ended, ["player_id"], ["ended_at", "id"], time_slice("ended_at"), upto_=running_sum(one)
    ).join(totals, "player_id")
    position = F.col("total") - F.col("upto_") + 1
    shown = clamp_page(F.lit(page), F.col("total"), size)
    rows = rows.withColumn("position", position).withColumn("page", shown).where(
        (F.col("position") > (F.col("page") - 1) * size) & (F.col("position") <= F.col("page") * size)
    )
    logins = d["sessions"].groupBy(F.col("life_id").alias("id")).agg(F.count("*").alias("session_count"))
    verdicts = d.verdicts.select(F.col("life_id").alias("id"), "verdict")
    return (
        rows.join(logins, "id", "left")
        .join(verdicts, "id", "left")
        .select(
            "player_id", "gamertag", F.col("id").alias("life_id"), "server_id", "map", "slug",
            "life_number", "started_at", "ended_at",
            F.col("playtime_seconds").alias("time_alive_seconds"), "kills", "longest_kill_meters",
            "death_cause", "death_by_gamertag", "death_weapon", "death_distance",
            F.col("verdict.cause").alias("verdict_cause"),
            F.col("verdict.confidence").alias("verdict_confidence"),
            F.array_join("verdict.conditions", ",").alias("verdict_conditions"),
            "energy_at_death", "water_at_death", "bleed_sources_at_death", "session_count",
            "position", "page", "total",
        )
    )


def player_page(d: Dataset, page: int = 1, size: int = PAST_LIVES_PAGE_SIZE) -> dict[str, DataFrame]:
    """The whole page for all players: head, standing per server, past lives, obituaries."""
    lives = d.life_status.where(F.col("qualified"))
    return {
        "head": page_totals(d),
        "standing": standings(d),
        "past_lives": past_lives(d, page, size),
        "obituaries": filed_obituaries(lives, d["articles"], d["player_gamertags"], d["servers"]),
    }


def player_priors(d: Dataset) -> DataFrame:
    """Reputation before each life: every earlier life of the player on any server.

    Running aggregates over (player; start), never a self join.  Lives that start at the same
    instant do not count for each other.  The usual cause is the running mode over cause
    families: each earlier death contributes (its family's count so far, earliest family), and
    the running maximum of that pair is the mode with ties to the family seen first.
    """
    places = d["servers"].select(F.col("id").alias("server_id"), "map")
    rows = d["lives"].join(places, "server_id").select(
        "id", "player_id", "started_at", "ended_at", "playtime_seconds", "death_cause", "map",
        F.nullif(cause_family(F.col("death_cause")), F.lit("")).alias("family"),
        (-F.unix_micros("started_at")).alias("older"),
    )
    by_family = rows.where(F.col("family").isNotNull())
    firsts = by_family.groupBy("player_id", "family").agg(
        F.max(F.struct("older", -F.col("id"))).alias("first_of")
    )
    counted = ordered_scan(
        by_family, ["player_id", "family"], ["started_at", "id"], time_slice("started_at"),
        n=running_sum(F.lit(1).cast("long")),
    ).join(firsts, ["player_id", "family"])
    marks = counted.select("id", F.struct("n", "first_of", "family").alias("mode"))

    best = F.when(
        F.col("playtime_seconds") > 0, F.struct("playtime_seconds", "older", (-F.col("id")).alias("i"), "map")
    )
    last = F.when(
        F.col("ended_at").isNotNull() & F.col("family").isNotNull(),
        F.struct("ended_at", "older", (-F.col("id")).alias("i"), "death_cause"),
    )
    per_life = rows.join(marks, "id", "left").withColumn("best", best).withColumn("last", last)
    # One row per distinct start instant, so that equal starts stay invisible to each other.
    starts = per_life.groupBy("player_id", "started_at").agg(
        F.count("*").alias("n"), F.max("best").alias("best"), F.max("mode").alias("mode"),
        F.max("last").alias("last"),
    )
    running = ordered_scan(
        starts, ["player_id"], ["started_at"], time_slice("started_at"),
        upto_lives=running_sum(F.col("n")),
        best_before=max_before(F.col("best")),
        mode_before=max_before(F.col("mode")),
        last_before=max_before(F.col("last")),
    )
    scored = d["kills"].where(F.col("killer_player_id").isNotNull()).select(
        F.col("killer_player_id").alias("player_id"), "occurred_at", "victim_life_id"
    )
    scored = ordered_scan(
        scored, ["player_id"], ["occurred_at", "victim_life_id"], time_slice("occurred_at"),
        so_far=running_sum(F.lit(1).cast("long")),
    )
    running = asof_join(
        running, scored, ["player_id"], "started_at", "occurred_at", "k", strict=True,
        tie=F.col("so_far"),
    )
    zero = F.lit(0).cast("long")
    return rows.select("id", "player_id", "started_at").join(running, ["player_id", "started_at"]).select(
        F.col("id").alias("life_id"), "player_id",
        (F.col("upto_lives") - F.col("n")).alias("lives_lived"),
        F.coalesce("best_before.playtime_seconds", zero).alias("longest_life_seconds"),
        F.coalesce("k.so_far", zero).alias("total_kills"),
        F.col("mode_before.family").alias("usual_death_cause"),
        F.col("last_before.death_cause").alias("last_death_cause"),
        F.col("best_before.map").alias("best_life_map"),
    )
