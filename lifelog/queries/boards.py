"""Boards, feeds, rosters and site statistics, for every server in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import SURVIVORS_PAGE_SIZE
from ..functions.scalars import live_playtime, seconds_between
from ..operators.aggregates import kill_counts
from ..operators.filters import is_qualified, live_servers
from ..operators.joins import avatar_hash, with_open_session
from ..operators.ordered import ranked, top_per_key
from ..operators.paging import page as page_of
from ..operators.paging import survivor_order
from ..operators.windows import killstreaks
from .dataset import Dataset


def survivor_candidates(d: Dataset) -> DataFrame:
    """Every open, qualified life on a live server."""
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    alive = d.life_status.where(F.col("ended_at").isNull() & F.col("qualified"))
    return alive.join(servers, "server_id").select(
        "player_id", "gamertag", "map", "slug",
        F.col("seconds").alias("time_alive_seconds"),
        F.col("kills").alias("kills_this_life"),
        "longest_kill_meters",
    )


def survivors(
    d: Dataset, page: int = 1, size: int = SURVIVORS_PAGE_SIZE, slug: str | None = None
) -> DataFrame:
    """One page of the survivors board; avatars are looked up for the visible page only."""
    rows = survivor_candidates(d)
    if slug is not None:
        rows = rows.where(F.col("slug") == slug)
    order = [*survivor_order(), F.col("slug").asc(), F.col("player_id").asc()]
    visible = page_of(rows, order, page, size)
    return avatar_hash(visible, d["gamertag_links"], d["avatars"])


def _board(rows: DataFrame, limit: int, *ties: str) -> DataFrame:
    order = [F.col("value").desc(), *[F.col(c).asc() for c in ties]]
    return top_per_key(rows, ["server_id"], order, limit)


def board_most_kills(d: Dataset, limit: int) -> DataFrame:
    rows = kill_counts(d["kills"], by="label").select(
        "server_id", F.col("killer_gamertag").alias("gamertag"), F.col("kills").alias("value")
    )
    return _board(rows, limit, "gamertag")


def board_longest_kills(d: Dataset, limit: int) -> DataFrame:
    rows = d["kills"].where(F.col("distance").isNotNull()).select(
        "server_id", F.col("killer_gamertag").alias("gamertag"), F.col("distance").alias("value"),
        F.col("victim_gamertag").alias("victim"), "weapon", "occurred_at",
    )
    return _board(rows, limit, "occurred_at", "gamertag", "victim").drop("occurred_at")


def board_alltime_longest(d: Dataset, limit: int) -> DataFrame:
    """Longest stored play time of a qualified life per label."""
    window = d.label_kills.join(
        d["lives"].select(F.col("id").alias("life_id"), F.coalesce("ended_at", d.now).alias("stop")),
        "life_id",
    ).where(F.col("occurred_at") <= F.col("stop"))
    kills = window.groupBy(F.col("life_id").alias("id")).agg(F.count("*").alias("kills"))
    rows = d.lives_of.join(kills, "id", "left").where(
        is_qualified(
            F.col("death_cause"), F.col("kills"), F.col("playtime_seconds"), d.qualify_seconds
        )
    )
    best = rows.groupBy("server_id", "gamertag").agg(F.max("playtime_seconds").alias("value"))
    return _board(best, limit, "gamertag")


def board_alive_longest(d: Dataset, limit: int) -> DataFrame:
    """Live play time of open qualified lives."""
    rows = with_open_session(d.lives_of.where(F.col("ended_at").isNull()), d["sessions"])
    up_to = F.coalesce("last_seen_at", "connected_at", d.now)
    rows = rows.select(
        "id", "server_id", "player_id", "gamertag", "death_cause", up_to.alias("up_to"),
        live_playtime(F.col("playtime_seconds"), F.col("connected_at"), up_to).alias("value"),
    )
    kills = (
        d.label_kills.join(rows.select(F.col("id").alias("life_id"), "up_to"), "life_id")
        .where(F.col("occurred_at") <= F.col("up_to"))
        .groupBy(F.col("life_id").alias("id")).agg(F.count("*").alias("kills"))
    )
    rows = rows.join(kills, "id", "left").where(
        is_qualified(F.col("death_cause"), F.col("kills"), F.col("value"), d.qualify_seconds)
    )
    return _board(rows.select("server_id", "gamertag", "player_id", "value"), limit, "gamertag", "player_id").drop(
        "player_id"
    )


def board_killstreak(d: Dataset, limit: int) -> DataFrame:
    """Most kills of one life per label; kills by unknown killers never count."""
    return _board(killstreaks(d["lives"], d["players"], _known_label_kills(d)), limit, "gamertag")


def _known_label_kills(d: Dataset) -> DataFrame:
    known = d["kills"].where(F.col("killer_player_id").isNotNull()).select(
        F.col("victim_life_id").alias("victim_life_id")
    )
    stops = d["lives"].select(F.col("id").alias("life_id"), F.coalesce("ended_at", d.now).alias("stop"))
    return (
        d.label_kills.join(known, "victim_life_id", "left_semi")
        .join(stops, "life_id")
        .where(F.col("occurred_at") <= F.col("stop"))
    )


def global_board(d: Dataset, board: DataFrame, limit: int) -> DataFrame:
    """Per-server boards of the live servers merged and ranked again."""
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    merged = board.drop("rank").join(servers, "server_id")
    order = [F.col("value").desc(), F.col("gamertag").asc(), F.col("slug").asc()]
    ties = [F.col(c).asc() for c in ("victim", "weapon") if c in merged.columns]
    return ranked(merged, [*order, *ties], limit)


def feed(df: DataFrame, limit: int, offset: int = 0, gamertag: str | None = None) -> DataFrame:
    """Kill or build feed, newest first; ``event_id`` settles equal instants."""
    rows = df if gamertag is None else df.where(F.col("gamertag") == gamertag)
    return ranked(rows, [F.col("occurred_at").desc(), F.col("event_id").desc()], limit, offset)


def roster(d: Dataset) -> DataFrame:
    """Open sessions with session and life seconds, capped at the heartbeat."""
    open_ = d["sessions"].where(F.col("disconnected_at").isNull()).select(
        F.col("life_id").alias("id"), "connected_at"
    )
    rows = d.lives_of.join(open_, "id")
    up_to = F.coalesce("last_seen_at", "connected_at")
    return rows.select(
        "server_id", "gamertag", "player_id",
        seconds_between(F.col("connected_at"), up_to).alias("session_seconds"),
        live_playtime(F.col("playtime_seconds"), F.col("connected_at"), up_to).alias("life_seconds"),
    )


def global_roster(d: Dataset) -> DataFrame:
    servers = live_servers(d["servers"]).select(F.col("id").alias("server_id"), "map", "slug")
    return roster(d).join(servers, "server_id")


def site_stats(d: Dataset) -> DataFrame:
    """All ended lives (qualified or not, all servers) and the survivors board total."""
    deaths = d["lives"].agg(F.count("ended_at").alias("deaths"))
    alive = survivor_candidates(d).agg(F.count("*").alias("alive"))
    return deaths.withColumn("alive", alive.scalar())
