"""Presence and position sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import map_label
from ..operators.filters import fresh, live_servers
from ..operators.joins import (
    LIFE_KEYS,
    effective_shares,
    recent_first,
    resolve_all_links,
    session_starts,
)
from ..operators.ordered import first_by, latest_by
from ..operators.paging import presence_rank
from .dataset import Dataset


def viewers(d: Dataset) -> DataFrame:
    """Users with a verified link and the person behind it (null before the first session)."""
    everyone = resolve_all_links(d["gamertag_links"], d["players"], "left")
    return latest_by(everyone, ["user_id"], [*recent_first(), F.col("link_gamertag")])


def shared_positions(d: Dataset) -> DataFrame:
    """Every position each viewer may see: their own and those granted for a running session.

    One row per (viewer, server, person).  A fix must be fresh and its person in session; the
    viewer's own last fix of the open life is shown even when stale.
    """
    self_rows = viewers(d).where(F.col("player_id").isNotNull()).select(
        F.col("user_id").alias("viewer_user_id"), "player_id",
        F.col("link_gamertag").alias("gamertag"),
    )
    granted = effective_shares(
        d["location_shares"], d["gamertag_links"], d["players"], d["sessions"]
    )
    granted = latest_by(
        granted, ["grantee_user_id", "server_id", "granter_user_id"], recent_first()
    ).select(
        F.col("grantee_user_id").alias("viewer_user_id"), "server_id", "player_id",
        F.col("granter_gamertag").alias("gamertag"), "last_seen_at", "granter_user_id",
    )
    granted = granted.join(self_rows.select("viewer_user_id").distinct(), "viewer_user_id", "left_semi")
    # Several granters may resolve to one person: the viewer first, then the most recently seen.
    granted = first_by(
        granted, ["viewer_user_id", "server_id", "player_id"], [F.col("granter_user_id")]
    ).join(self_rows.select("viewer_user_id", "player_id"), ["viewer_user_id", "player_id"], "left_anti")

    in_session = d["sessions"].where(F.col("disconnected_at").isNull()).select(*LIFE_KEYS).distinct()
    recent = d["positions"].where(fresh(F.col("recorded_at"), d.now, d.fresh_seconds))
    newest = latest_by(
        recent.join(in_session, LIFE_KEYS, "left_semi").select(
            *LIFE_KEYS, "x", "y", "recorded_at", "event_id"
        ),
        LIFE_KEYS, [F.col("recorded_at"), F.col("event_id")],
    )
    columns = ["viewer_user_id", "server_id", "gamertag", "x", "y", "recorded_at", "is_self"]
    own = self_rows.join(newest, "player_id").withColumn("is_self", F.lit(True))
    others = granted.join(newest, LIFE_KEYS).withColumn("is_self", F.lit(False))

    open_lives = latest_by(
        d["lives"].where(F.col("ended_at").isNull()).select(*LIFE_KEYS, "started_at", "id"),
        LIFE_KEYS, [F.col("started_at"), F.col("id")],
    )
    idle = self_rows.join(open_lives, "player_id").join(
        own.select("viewer_user_id", "server_id"), ["viewer_user_id", "server_id"], "left_anti"
    )
    # The newest fix of each open life first; only that one row meets the life's viewers.
    last = latest_by(
        d["positions"].select(*LIFE_KEYS, "x", "y", "recorded_at", "event_id")
        .join(idle.select(*LIFE_KEYS, "started_at").distinct(), LIFE_KEYS)
        .where(F.col("recorded_at") >= F.col("started_at")).drop("started_at"),
        LIFE_KEYS, [F.col("recorded_at"), F.col("event_id")],
    )
    stale = last.join(idle.select(*LIFE_KEYS, "viewer_user_id", "gamertag"), LIFE_KEYS)
    stale = latest_by(
        stale, ["viewer_user_id", "server_id"], [F.col("recorded_at"), F.col("event_id")]
    ).withColumn("is_self", F.lit(True))
    return (
        own.select(columns).unionByName(others.select(columns)).unionByName(stale.select(columns))
    )


def online_now(d: Dataset) -> DataFrame:
    """(server, player, label) of open sessions with fresh evidence on that very server."""
    open_ = d["sessions"].where(F.col("disconnected_at").isNull()).select(*LIFE_KEYS, "connected_at")
    joined = open_.where(fresh(F.col("connected_at"), d.now, d.fresh_seconds)).select(*LIFE_KEYS)
    seen = d["positions"].where(fresh(F.col("recorded_at"), d.now, d.fresh_seconds)).select(*LIFE_KEYS)
    evidence = joined.unionByName(seen).distinct()
    names = d["players"].select(F.col("id").alias("player_id"), "gamertag")
    return (
        open_.select(*LIFE_KEYS).distinct()
        .join(evidence, LIFE_KEYS, "left_semi").join(names, "player_id")
    )


def online_players(d: Dataset, viewer_user_id: str, positions: DataFrame) -> DataFrame:
    """Who is online on each server as one viewer sees it: self, sharing, others, then name.

    A viewer with several verified labels is each of them.

    ``positions`` is the viewer's :func:`shared_positions`, so list and dots cannot disagree.
    """
    mine = d["gamertag_links"].where(
        (F.col("status") == "verified") & (F.col("user_id") == viewer_user_id)
    ).select(F.lower("gamertag").alias("label")).distinct().withColumn("is_self", F.lit(True))
    shown = positions.where(F.col("viewer_user_id") == viewer_user_id).select(
        "server_id", F.lower("gamertag").alias("label")
    ).distinct().withColumn("sharing", F.lit(True))
    rows = online_now(d).select("server_id", "gamertag").distinct()
    rows = (
        rows.withColumn("label", F.lower("gamertag"))
        .join(mine, "label", "left").join(shown, ["server_id", "label"], "left")
        .fillna(False, ["is_self", "sharing"]).drop("label")
    )
    return rows.withColumn("rank", presence_rank(F.col("is_self"), F.col("sharing")))


def presence_marks(d: Dataset, positions: DataFrame) -> DataFrame:
    """(viewer, server, label, is_self, sharing) where an online player is more than another name
    to a viewer.

    With :func:`online_now` it gives every viewer's list; a viewer sees whoever has no mark last.
    Sparse: one row per own label online and per position shown, never viewers times players.
    """
    online = online_now(d).select("server_id", F.lower("gamertag").alias("label")).distinct()
    own = d["gamertag_links"].where(F.col("status") == "verified").select(
        F.col("user_id").alias("viewer_user_id"), F.lower("gamertag").alias("label")
    ).distinct().join(online, "label").withColumns({"is_self": F.lit(True), "sharing": F.lit(False)})
    shown = positions.select("viewer_user_id", "server_id", F.lower("gamertag").alias("label")).distinct().join(
        online, ["server_id", "label"]
    ).withColumns({"is_self": F.lit(False), "sharing": F.lit(True)})
    return own.unionByName(shown).groupBy("viewer_user_id", "server_id", "label").agg(
        F.bool_or("is_self").alias("is_self"), F.bool_or("sharing").alias("sharing")
    )


def last_played(d: Dataset) -> DataFrame:
    """Slug of the live server each verified user connected to last."""
    people = latest_by(
        resolve_all_links(d["gamertag_links"], d["players"]), ["user_id"],
        [*recent_first(), F.col("link_gamertag")],
    ).select("user_id", "player_id")
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "slug")
    logins = d["sessions"].join(servers, "server_id").groupBy("player_id").agg(
        F.max_by("slug", F.struct("connected_at", "id")).alias("slug")
    )
    return people.join(logins, "player_id").select("user_id", "slug")


def map_destination(d: Dataset, visits: DataFrame) -> DataFrame:
    """Map to open: the remembered one if still live, else last played, else first by label.

    ``visits(user_id, session_slug)``.
    """
    live = live_servers(d["servers"])
    first = live.agg(F.min_by("slug", F.struct(map_label(F.col("map")), "slug")).alias("slug"))
    known = live.select(F.col("slug").alias("session_slug")).distinct().withColumn("ok", F.lit(True))
    played = last_played(d).withColumnRenamed("slug", "last_slug")
    return (
        visits.join(known, "session_slug", "left").join(played, "user_id", "left")
        .select(
            "user_id",
            F.coalesce(F.when(F.col("ok"), F.col("session_slug")), F.col("last_slug"), first.scalar())
            .alias("slug"),
        )
    )


def sharing_with(d: Dataset) -> DataFrame:
    """Labels each granter is sharing with during the running session."""
    granter = latest_by(
        resolve_all_links(d["gamertag_links"], d["players"]), ["user_id"],
        [*recent_first(), F.col("link_gamertag")],
    ).select(F.col("user_id").alias("granter_user_id"), "player_id")
    starts = session_starts(d["sessions"]).withColumnRenamed(
        "connected_at", "granter_session_connected_at"
    )
    tags = d["gamertag_links"].where(F.col("status") == "verified").select(
        F.col("user_id").alias("grantee_user_id"), F.col("gamertag").alias("grantee_gamertag")
    )
    return (
        d["location_shares"].join(granter, "granter_user_id")
        .join(starts, [*LIFE_KEYS, "granter_session_connected_at"])
        .join(tags, "grantee_user_id")
        .select("granter_user_id", "server_id", "grantee_gamertag")
    )
