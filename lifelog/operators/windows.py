"""Ordered per-key computations: qualification instants, encounters, streaks, play clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ENCOUNTER_GAP_SECONDS, QUALIFY_SECONDS, RECENT_WINDOW_SECONDS
from ..functions.scalars import entity_class, is_fire, round_half_up, seconds_between
from .ordered import event_slice, ordered_scan, running_sum, sum_before, time_slice
from .temporal import asof_join, interval_join, islands


def qualified_at(
    lives: DataFrame,
    sessions: DataFrame,
    kills_in_lives: DataFrame,
    last_seen: DataFrame,
    seconds: int = QUALIFY_SECONDS,
) -> DataFrame:
    """(life_id, qualified_at, qualified_by): the earliest of a PvP death, the first kill, and
    the moment cumulative session time reaches ``seconds``.  On equal instants: pvp-death, kill,
    playtime.  Lives that never qualify have no row.

    ``last_seen(player_id, last_seen_at)`` caps open sessions.
    """
    pvp = lives.where((F.col("death_cause") == "pvp") & F.col("ended_at").isNotNull()).select(
        F.col("id").alias("life_id"), F.col("ended_at").alias("at"), F.lit(0).alias("rank")
    )
    kill = kills_in_lives.groupBy("life_id").agg(F.min("occurred_at").alias("at")).withColumn(
        "rank", F.lit(1)
    )
    played = sessions.join(last_seen.select("player_id", "last_seen_at"), "player_id", "left")
    share = F.when(
        F.col("disconnected_at").isNotNull(),
        F.coalesce("duration_seconds", seconds_between(F.col("connected_at"), F.col("disconnected_at"))),
    ).otherwise(F.coalesce(seconds_between(F.col("connected_at"), F.col("last_seen_at")), F.lit(0).cast("long")))
    clock = ordered_scan(
        played.select("life_id", "id", "connected_at", share.alias("share")),
        ["life_id"],
        ["connected_at", "id"],
        time_slice("connected_at"),
        before=sum_before(F.col("share")),
    )
    crossed = (
        clock.where((F.col("before") < seconds) & (F.col("before") + F.col("share") >= seconds))
        .select(
            "life_id",
            F.timestamp_micros(
                F.unix_micros("connected_at") + (F.lit(seconds) - F.col("before")) * 1_000_000
            ).alias("at"),
            F.lit(2).alias("rank"),
        )
    )
    first = (
        pvp.unionByName(kill).unionByName(crossed)
        .groupBy("life_id")
        .agg(F.min(F.struct("at", "rank")).alias("q"))
    )
    return first.select(
        "life_id",
        F.col("q.at").alias("qualified_at"),
        F.when(F.col("q.rank") == 0, "pvp-death").when(F.col("q.rank") == 1, "kill")
        .otherwise("playtime").alias("qualified_by"),
    )


def encounters(hits: DataFrame, keys: list[str], gap_seconds: float = ENCOUNTER_GAP_SECONDS) -> DataFrame:
    """Number the encounters of each key; a gap above ``gap_seconds`` starts a new one."""
    return islands(hits, keys, "occurred_at", "event_id", gap_seconds, "encounter")


def life_encounters(
    hits_in_lives: DataFrame,
    ended: DataFrame,
    gap_seconds: float = ENCOUNTER_GAP_SECONDS,
    recent_seconds: float = RECENT_WINDOW_SECONDS,
) -> DataFrame:
    """Encounter spans of each life, by fire, infected, single attacker, animal or environment.

    Spans whose last hit falls within ``recent_seconds`` of the death are left to the death row.
    ``ended(life_id, ended_at)``.
    """
    attacker = F.lower(F.coalesce("attacker_gamertag", F.lit("")))
    category = (
        F.when(is_fire(F.col("attacker_label")), "fire")
        .when(F.col("attacker_type") == "infected", "infected")
        .when(F.col("attacker_type") == "player", "player")
        .otherwise(F.coalesce(entity_class(F.col("attacker_label")), F.lit("environment")))
    )
    ticks = hits_in_lives.select(
        "life_id", "occurred_at", "event_id", "victim_hp", "attacker_gamertag",
        category.alias("category"),
        F.when(category == "player", attacker).otherwise("").alias("attacker"),
    )
    runs = encounters(ticks, ["life_id", "category", "attacker"], gap_seconds)
    spans = runs.groupBy("life_id", "category", "attacker", "encounter").agg(
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("last_at"),
        F.min_by("attacker_gamertag", F.struct("occurred_at", "event_id")).alias("first_attacker"),
        F.count("*").alias("hits"),
        F.min("victim_hp").alias("hp_low"),
    )
    spans = spans.join(ended.select("life_id", "ended_at"), "life_id", "left")
    told = (F.unix_millis("ended_at") - F.unix_millis("last_at")) / 1000 <= recent_seconds
    return spans.where(F.col("ended_at").isNull() | ~told).select(
        "life_id", "category",
        F.when(F.col("category") == "player", F.col("first_attacker")).alias("attacker_gamertag"),
        "started_at",
        round_half_up((F.unix_millis("last_at") - F.unix_millis("started_at")) / 1000)
        .alias("duration_seconds"),
        "hits", "hp_low",
    )


def session_ordinals(sessions: DataFrame) -> DataFrame:
    """Sessions with ``ordinal``, their 1-based rank within the life."""
    out = ordered_scan(
        sessions, ["life_id"], ["connected_at", "id"], time_slice("connected_at"),
        ordinal=running_sum(F.lit(1).cast("long")),
    )
    return out


def session_groups(sessions: DataFrame, kills_in_lives: DataFrame, now) -> DataFrame:
    """Timeline rows for the sessions of a life after the first.

    A run of two or more sessions without a kill becomes one ``session-group`` row; every other
    session is its own row.  Columns: life_id, kind, first, last (ordinals), at.
    """
    spans = sessions.select(
        "life_id", "id", "connected_at", F.coalesce("disconnected_at", now).alias("until")
    )
    scored = interval_join(
        kills_in_lives.select("life_id", "occurred_at"), spans, ["life_id"], "occurred_at",
        "connected_at", "until", "s", tie="id",
    ).select(F.col("s.id").alias("id")).distinct().withColumn("scored", F.lit(True))
    rows = session_ordinals(spans).where(F.col("ordinal") >= 2).join(scored, "id", "left")
    rows = rows.withColumn("scored", F.coalesce("scored", F.lit(False)))
    # Each scoring session is its own island; quiet sessions share the island opened after it.
    rows = ordered_scan(
        rows, ["life_id"], ["ordinal"], event_slice("ordinal"),
        island=running_sum(F.col("scored").cast("long")),
    )
    runs = rows.groupBy("life_id", "island", "scored").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"),
        F.min_by("connected_at", "ordinal").alias("at"),
    )
    return runs.select(
        "life_id",
        F.when(F.col("last") > F.col("first"), "session-group").otherwise("session").alias("kind"),
        "first", "last", "at",
    )


def played_seconds_at(
    points: DataFrame, sessions: DataFrame, last_seen: DataFrame, at: str = "at"
) -> DataFrame:
    """Add ``played_seconds``: play time of the life up to ``at``.

    Whole sessions before plus the started part of the session in progress.  Sessions of a life
    follow each other, so the running total at the last started session decides.
    """
    capped = sessions.join(last_seen.select("player_id", "last_seen_at"), "player_id", "left")
    until = F.coalesce("disconnected_at", "last_seen_at", "connected_at")
    whole = F.coalesce("duration_seconds", seconds_between(F.col("connected_at"), until))
    clock = ordered_scan(
        capped.select("life_id", "id", "connected_at", until.alias("until"), whole.alias("whole")),
        ["life_id"], ["connected_at", "id"], time_slice("connected_at"),
        before=sum_before(F.col("whole")),
    )
    found = asof_join(points, clock, ["life_id"], at, "connected_at", "__s", tie=F.col("id"), strict=True)
    part = F.when(F.col(at) >= F.col("__s.until"), F.col("__s.whole")).otherwise(
        seconds_between(F.col("__s.connected_at"), F.col(at))
    )
    return found.withColumn(
        "played_seconds", F.coalesce(F.col("__s.before") + part, F.lit(0).cast("long"))
    ).drop("__s")


def killstreaks(lives: DataFrame, players: DataFrame, kills_in_lives: DataFrame) -> DataFrame:
    """Most kills within one life, per server and current label."""
    per_life = kills_in_lives.groupBy(F.col("life_id").alias("id")).agg(F.count("*").alias("kills"))
    names = players.select(F.col("id").alias("player_id"), "gamertag")
    return (
        lives.join(per_life, "id").join(names, "player_id")
        .groupBy("server_id", "gamertag").agg(F.max("kills").alias("value"))
    )


def segment_track(points: DataFrame, sessions: DataFrame, cap: DataFrame) -> DataFrame:
    """Points of a life with the session that contains them.

    ``points(life_id, recorded_at, ...)``; ``cap(life_id, cap_at)`` ends an open session.
    """
    spans = sessions.join(cap, "life_id", "left").select(
        "life_id", F.col("id").alias("session_id"), "connected_at",
        F.coalesce("disconnected_at", F.greatest("cap_at", "connected_at")).alias("until"),
    )
    pairs = interval_join(
        points, spans, ["life_id"], "recorded_at", "connected_at", "until", "s", tie="session_id"
    )
    return pairs.select(*points.columns, F.col("s.session_id").alias("session_id"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """Ledger with the running balance and a flag on spends made without a token to spend."""
    out = ordered_scan(
        ledger, ["user_id"], ["id"], event_slice("id"),
        balance=running_sum(F.col("delta").cast("long")),
    )
    return out.withColumn(
        "overdraft", (F.col("delta") < 0) & (F.col("balance") - F.col("delta") < 1)
    )


