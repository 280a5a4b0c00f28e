"""Identity, natural-key, as-of and interval joins over the projection tables.

Size-based broadcast is left to adaptive execution: it measures the side at run time and falls
back to a shuffle join beyond ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import FRESH_SECONDS
from ..functions.scalars import round_half_up
from .filters import live_servers
from ..staging import stage
from .ordered import first_by, latest_by
from .temporal import asof_join, interval_join

LIFE_KEYS = ["server_id", "player_id"]
#: Rows of one key in a block of ``block_join``.
PAIR_BLOCK = 2_000
MAX_BLOCK_TASKS = 10_000


def recent_first(seen: str = "last_seen_at", tie: str = "player_id") -> list[Column]:
    """Order for ``latest_by``: most recently seen wins, never seen last, lowest id on a tie."""
    return [F.col(seen), -F.col(tie)]


def with_players(lives: DataFrame, players: DataFrame) -> DataFrame:
    """Lives with the current label and heartbeat of their player."""
    who = players.select(
        F.col("id").alias("player_id"), "gamertag", "dayz_id", "first_seen_at", "last_seen_at"
    )
    return lives.join(who, "player_id")


def with_servers(df: DataFrame, servers: DataFrame) -> DataFrame:
    where = servers.select(
        F.col("id").alias("server_id"), F.col("name").alias("server_name"), "map", "slug"
    )
    return df.join(where, "server_id")


def with_open_session(lives: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lives with ``connected_at`` of their open session, null when offline."""
    open_ = sessions.where(F.col("disconnected_at").isNull()).select(
        F.col("life_id").alias("id"), "connected_at"
    )
    return lives.join(open_, "id", "left")


def resolve_links(links: DataFrame, players: DataFrame, how: str = "inner") -> DataFrame:
    """Verified links with the person behind their label: one winner per link.

    The winner is found per label first, so links and people that share a label never meet pairwise.
    """
    verified = links.where(F.col("status") == "verified").select(
        F.col("id").alias("link_id"), "user_id", F.col("gamertag").alias("link_gamertag"),
        F.lower("gamertag").alias("label"),
    )
    people = players.select(
        F.lower("gamertag").alias("label"), F.col("id").alias("player_id"), "gamertag", "last_seen_at"
    )
    people = latest_by(people, ["label"], recent_first())
    return latest_by(verified.join(people, "label", how), ["link_id"], recent_first())


def resolve_names(
    df: DataFrame, name: str, players: DataFrame, aliases: DataFrame, norm=F.lower
) -> DataFrame:
    """Name -> person: current labels win outright, else the most recent holder of the name.

    Adds ``player_id`` (null when unknown) and ``via_alias``.  ``norm`` maps a label to its match
    key: ``F.lower`` for labels, ``functions.scalars.slug`` for page addresses.
    """
    current = players.select(
        norm(F.col("gamertag")).alias("__key"), F.col("id").alias("player_id"), "last_seen_at"
    ).where(F.col("__key") != "")
    current = latest_by(current, ["__key"], recent_first()).select(
        "__key", F.col("player_id").alias("__current")
    )
    past = aliases.select(norm(F.col("gamertag")).alias("__key"), "player_id", "last_seen_at").where(
        F.col("__key") != ""
    )
    past = latest_by(past, ["__key"], recent_first()).select(
        "__key", F.col("player_id").alias("__past")
    )
    return (
        df.withColumn("__key", norm(F.col(name)))
        .join(current, "__key", "left")
        .join(past, "__key", "left")
        .withColumn("player_id", F.coalesce("__current", "__past"))
        .withColumn("via_alias", F.col("__current").isNull() & F.col("__past").isNotNull())
        .drop("__key", "__current", "__past")
    )


def resolve_slugs(df: DataFrame, column: str, players: DataFrame, aliases: DataFrame) -> DataFrame:
    from ..functions.scalars import slug

    return resolve_names(df, column, players, aliases, slug)


def life_at(points: DataFrame, lives: DataFrame, at: str = "occurred_at") -> DataFrame:
    """Points with ``life_id``: latest life with start <= t < end, null when none."""
    spans = lives.select(*LIFE_KEYS, F.col("id").alias("life_id"), "started_at", "ended_at")
    found = asof_join(points, spans, LIFE_KEYS, at, "started_at", "__life", tie=F.col("life_id"))
    holds = F.col("__life.ended_at").isNull() | (F.col("__life.ended_at") > F.col(at))
    return found.withColumn("life_id", F.when(holds, F.col("__life.life_id"))).drop("__life")


def in_lives(points: DataFrame, lives: DataFrame, at: str, end: str = "ended_at") -> DataFrame:
    """(point, life) pairs with start <= t <= end; a null end is open.  Adds ``life_id``,
    ``life_started_at`` and ``life_end``."""
    spans = lives.select(
        *LIFE_KEYS, F.col("id").alias("life_id"), F.col("started_at").alias("life_started_at"),
        F.col(end).alias("life_end"),
    )
    pairs = interval_join(
        points, spans, LIFE_KEYS, at, "life_started_at", "life_end", "__life", tie="life_id"
    )
    return pairs.select(*points.columns, "__life.life_id", "__life.life_started_at", "__life.life_end")


def life_kills(
    lives: DataFrame,
    kills: DataFrame,
    by: str = "id",
    players: DataFrame | None = None,
    end: str = "ended_at",
) -> DataFrame:
    """Kills a life scored within [start, end].

    ``by="id"`` matches the killer's identity; ``by="label"`` matches the name on the kill with
    the player's current label, as the boards and the ban planner do.
    """
    if by == "id":
        scored = kills.where(F.col("killer_player_id").isNotNull()).withColumn(
            "player_id", F.col("killer_player_id")
        )
    else:
        names = players.select(
            F.col("gamertag").alias("killer_gamertag"), F.col("id").alias("player_id")
        )
        scored = kills.join(names, "killer_gamertag")
    scored = scored.select(
        *LIFE_KEYS, "victim_gamertag", "weapon", "distance", "occurred_at", "victim_life_id"
    )
    return in_lives(scored, lives, "occurred_at", end)


def kill_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("life_id").agg(
        F.count("*").alias("kills"),
        F.min("occurred_at").alias("first_kill_at"),
        F.max("distance").alias("longest_kill_meters"),
    )


def life_hits(lives: DataFrame, hits: DataFrame, end: str = "ended_at") -> DataFrame:
    taken = hits.where(F.col("victim_player_id").isNotNull()).select(
        "server_id", F.col("victim_player_id").alias("player_id"), "attacker_type",
        "attacker_gamertag", "attacker_label", "victim_hp", "occurred_at", "event_id",
    )
    return in_lives(taken, lives, "occurred_at", end)


def life_knockouts(lives: DataFrame, knockouts: DataFrame, end: str = "ended_at") -> DataFrame:
    return in_lives(
        knockouts.select(*LIFE_KEYS, "disconnecting", "occurred_at"), lives, "occurred_at", end
    )


def asof_fix(
    events: DataFrame, positions: DataFrame, at: str, max_age_seconds: float = FRESH_SECONDS
) -> DataFrame:
    """Last fix at or before each event, dropped when older than ``max_age_seconds``.

    Of several fixes at one instant the first logged one counts.
    """
    fixes = positions.select(*LIFE_KEYS, "event_id", "x", "y", "recorded_at")
    found = asof_join(
        events, fixes, LIFE_KEYS, at, "recorded_at", "__fix", tie=-F.col("event_id")
    ).where(F.col("__fix").isNotNull())
    age = round_half_up((F.unix_millis(at) - F.unix_millis("__fix.recorded_at")) / 1000)
    return (
        found.withColumn("sample_age_seconds", age)
        .where(F.col("sample_age_seconds") <= max_age_seconds)
        .withColumn("x", F.col("__fix.x"))
        .withColumn("y", F.col("__fix.y"))
        .withColumn("sample_at", F.col("__fix.recorded_at"))
        .drop("__fix")
    )


def unbanned_lives(
    lives: DataFrame,
    players: DataFrame,
    bans: DataFrame,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Ended lives without a ban row on (server, label, life start).

    The label is the current one, so a rename reopens a life; pass ``aliases`` to match any
    label the player ever carried instead.
    """
    ended = with_players(lives.where(F.col("ended_at").isNotNull()), players)
    keys = bans.select("server_id", "gamertag", F.col("life_started_at").alias("started_at")).distinct()
    if aliases is None:
        return ended.join(keys, ["server_id", "gamertag", "started_at"], "left_anti")
    held = aliases.select("player_id", F.lower("gamertag").alias("label")).distinct()
    owned = keys.select("server_id", F.lower("gamertag").alias("label"), "started_at").join(held, "label")
    return ended.join(owned, ["server_id", "player_id", "started_at"], "left_anti")


def claimable(players: DataFrame, links: DataFrame) -> DataFrame:
    """Observed labels without a verified claim; label equality is case-sensitive here."""
    taken = links.where(F.col("status") == "verified").select("gamertag")
    return players.select("gamertag").join(taken, "gamertag", "left_anti")


def filed_obituaries(
    lives: DataFrame, articles: DataFrame, aliases: DataFrame, servers: DataFrame
) -> DataFrame:
    """Published obituaries of ended lives, found through every label the player ever held.

    ``lives`` are the lives the page may list (ended and qualified, live servers).
    """
    published = articles.where(
        (F.col("kind") == "obituary") & (F.col("status") == "published") & F.col("slug").isNotNull()
    ).select(
        F.lower("gamertag").alias("label"), "server_id",
        F.col("life_started_at").alias("started_at"), "slug", "headline", "lede", "death_at",
        F.col("life_number").alias("__n"),
    )
    held = aliases.select("player_id", F.lower("gamertag").alias("label")).distinct()
    mine = published.join(held, "label")
    places = live_servers(servers).select(
        F.col("id").alias("server_id"), "map", F.col("slug").alias("map_slug")
    )
    return (
        lives.where(F.col("ended_at").isNotNull())
        .select("id", "server_id", "player_id", "started_at", "ended_at", "life_number")
        .join(mine, ["server_id", "player_id", "started_at"])
        .join(places, "server_id")
        .select(
            "player_id", F.col("id").alias("life_id"), "server_id", "slug", "map", "map_slug",
            F.coalesce("__n", "life_number").alias("life_number"),
            F.coalesce("headline", F.lit("")).alias("headline"), "lede",
            F.coalesce("death_at", "ended_at").alias("death_at"),
        )
    )


def owned_bans(
    links: DataFrame, bans: DataFrame, players: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Open real bans of each user, joined by person rather than by name.

    The result is every ban of a person with every user of that person, however many there are.
    """
    mine = resolve_names(
        links.where(F.col("status") == "verified").select("user_id", "gamertag"),
        "gamertag", players, aliases,
    ).where(F.col("player_id").isNotNull()).select("user_id", "player_id").distinct()
    open_ = bans.where(F.col("status").isin("pending", "applied") & ~F.col("dry_run"))
    people = resolve_names(
        open_.select("gamertag").distinct(), "gamertag", players, aliases
    ).select("gamertag", "player_id")
    theirs = open_.join(people, "gamertag").select(
        "player_id", F.col("id").alias("ban_id"), "server_id", "gamertag", "status", "banned_at"
    )
    pairs = block_join(stage(theirs, "open-bans"), stage(mine, "ban-owners"), ["player_id"])
    return pairs.select("user_id", "ban_id", "server_id", "gamertag", "status", "banned_at")


def block_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = PAIR_BLOCK) -> DataFrame:
    """Inner join on ``keys`` where a key may have many rows on both sides.

    Rows of a key fall into blocks of about ``block`` rows on either side, and each pair of blocks is a
    join key of its own, so the pairs of a hot key spread over as many tasks as their number asks for.
    Both inputs are read twice.
    """
    sizes = stage(
        left.groupBy(*keys).agg(F.count("*").alias("__l")).join(
            right.groupBy(*keys).agg(F.count("*").alias("__r")), keys
        ), "block-sizes")
    pairs = sizes.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0
    if pairs <= block * block:
        return left.join(right, keys)
    # A number of its own keeps adaptive execution from merging tasks by their small input.
    tasks = max(
        int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * pairs / (block * block))
    )
    tasks = min(tasks, MAX_BLOCK_TASKS)
    cell = [*keys, "__i", "__j"]

    def blocks(df: DataFrame, mine: str, other: str, own: str, each: str) -> DataFrame:
        number = F.ceil(F.col(mine) / block)
        last = F.ceil(F.col(other) / block) - 1
        return (
            df.join(sizes, keys)
            .select(*df.columns, F.pmod(F.xxhash64(*df.columns), number).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(each))
            .repartition(tasks, *cell)
        )

    return blocks(left, "__l", "__r", "__i", "__j").join(blocks(right, "__r", "__l", "__j", "__i"), cell).drop("__i", "__j")


def avatar_hash(df: DataFrame, links: DataFrame, avatars: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``avatar_hash`` for ``df(player_id, gamertag)``: the exact current label outranks an
    alias; only verified links count."""
    owned = (
        links.where(F.col("status") == "verified")
        .join(avatars.where(F.col("hash").isNotNull()), "user_id")
        .select(F.lower("gamertag").alias("label"), "hash", F.col("id").alias("link_id"))
    )
    owned = first_by(owned, ["label"], [F.col("link_id")])
    current = owned.select(F.col("label").alias("__label"), F.col("hash").alias("avatar_hash"))
    found = df.join(current, F.lower("gamertag") == F.col("__label"), "left").drop("__label")
    if aliases is None:
        return found
    held = aliases.select("player_id", F.lower("gamertag").alias("label")).join(owned, "label")
    past = first_by(held, ["player_id"], [F.col("link_id"), F.col("label")]).select(
        "player_id", F.col("hash").alias("__past")
    )
    return found.join(past, "player_id", "left").withColumn(
        "avatar_hash", F.coalesce("avatar_hash", "__past")
    ).drop("__past")


def session_starts(sessions: DataFrame) -> DataFrame:
    """Open session start per (server, player): the newest when several are open."""
    open_ = sessions.where(F.col("disconnected_at").isNull())
    return open_.groupBy(*LIFE_KEYS).agg(F.max("connected_at").alias("connected_at"))


def effective_shares(
    shares: DataFrame, links: DataFrame, players: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Grants whose stored session start equals the granter's open session on that server."""
    granter = resolve_all_links(links, players).select(
        F.col("user_id").alias("granter_user_id"), "player_id",
        F.col("link_gamertag").alias("granter_gamertag"), "last_seen_at",
    )
    open_ = sessions.where(F.col("disconnected_at").isNull()).select(
        *LIFE_KEYS, F.col("connected_at").alias("granter_session_connected_at")
    ).distinct()
    return (
        shares.join(granter, "granter_user_id")
        .join(open_, [*LIFE_KEYS, "granter_session_connected_at"])
        .select(
            "granter_user_id", "grantee_user_id", "server_id", "player_id", "granter_gamertag",
            "granter_session_connected_at", "last_seen_at",
        )
    )


def resolve_all_links(links: DataFrame, players: DataFrame, how: str = "inner") -> DataFrame:
    """Verified links joined to every person carrying the label; callers pick the winner."""
    verified = links.where(F.col("status") == "verified").select(
        "user_id", F.col("gamertag").alias("link_gamertag"), F.lower("gamertag").alias("label")
    )
    people = players.select(
        F.lower("gamertag").alias("label"), F.col("id").alias("player_id"), "last_seen_at"
    )
    return verified.join(people, "label", how).drop("label")
