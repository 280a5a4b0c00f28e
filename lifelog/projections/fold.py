"""Projections of the event log.

Input is the *typed* event table of :func:`lifelog.sources.payload.typed_events`; rows are
ordered by ``event_id``, never by time.  Ids are event ids - a player is the first connect of
an account hash, a life or session the connect that opened it - so they survive a rebuild and
sort in creation order.

Only connect rows that carry an account hash create or touch a player; connects without one do
not occur in parsed logs and belong to the quarantine output of ``validate_events``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import (
    event_slice,
    first_by,
    following,
    ordered_scan,
    prev,
    sum_before,
    upto,
)
from ..operators.temporal import asof_join, last_open_span
from ..schemas import BUILD_TYPES
from ..staging import stage

CONNECT, DISCONNECT, DEATH = "player.connected", "player.disconnected", "player.died"
HIT, POSITION, KNOCKOUT, BOOT = "player.hit", "player.position", "player.unconscious", "server.rebooted"

_BY_LABEL = [DISCONNECT, DEATH, HIT, POSITION, KNOCKOUT, *BUILD_TYPES]


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never negative; instants have millisecond precision."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(end) - F.unix_millis(start)) / 1000))


def _connects(events: DataFrame) -> DataFrame:
    """Connect rows with the id of the person: the first connect of the account hash."""
    rows = events.where(
        (F.col("type") == CONNECT) & F.col("dayz_id").isNotNull() & F.col("gamertag").isNotNull()
    )
    people = rows.groupBy("dayz_id").agg(F.min("event_id").alias("player_id"))
    return rows.join(people, "dayz_id").select(*rows.columns, "player_id")


def _tenures(connects: DataFrame) -> DataFrame:
    """Per connect: the label taken and the event at which the person moves to another label."""
    rows = connects.select("event_id", "player_id", "gamertag", F.lower("gamertag").alias("label"))
    rows = ordered_scan(
        rows, ["player_id"], ["event_id"], event_slice(), __last=prev(F.col("label"))
    )
    renamed = F.when(F.col("label") != F.col("__last"), F.col("event_id"))
    rows = ordered_scan(
        rows, ["player_id"], ["event_id"], event_slice(), left_at=following(renamed)
    )
    return rows.drop("__last")


def _holders(tenures: DataFrame) -> DataFrame:
    """Who a label points at, as a change log (label, event_id, player_id, gamertag).

    A connect takes the label.  A rename gives it back to the latest other connecter who still
    carries it, or to nobody; only labels used by several people can fall back.
    """
    pushes = tenures.select("label", "event_id", "player_id", "gamertag")
    pops = tenures.where(F.col("left_at").isNotNull()).select(
        "label", F.col("left_at").alias("event_id")
    ).distinct()
    shared = (
        tenures.groupBy("label")
        .agg(F.min("player_id").alias("a"), F.max("player_id").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("label")
    )
    claims = tenures.join(shared, "label", "left_semi").select("label", "event_id", "left_at", "player_id", "gamertag")
    back = last_open_span(
        pops.join(shared, "label", "left_semi"), claims, ["label"], "event_id", "event_id", "left_at", "holder"
    )
    emptied = pops.join(shared, "label", "left_anti").withColumn("holder", F.lit(None).cast(back.schema["holder"].dataType))
    fallback = back.unionByName(emptied).select("label", "event_id", "holder.player_id", "holder.gamertag")
    return pushes.unionByName(fallback)


def _resolve(events: DataFrame, connects: DataFrame, holders: DataFrame) -> DataFrame:
    """Every connect by hash; every other player event by whoever holds its label just then."""
    known = connects.withColumn("player_gamertag", F.col("gamertag"))
    refs = events.where(F.col("type").isin(_BY_LABEL))
    resolved = _as_of_label(refs, F.coalesce("gamertag", "victim"), holders, "__holder").select(
        *events.columns,
        F.col("__holder.player_id").alias("player_id"),
        F.col("__holder.gamertag").alias("player_gamertag"),
    )
    boots = events.where(F.col("type") == BOOT)
    return known.unionByName(resolved).unionByName(boots, allowMissingColumns=True)


def _as_of_label(refs: DataFrame, label: Column, holders: DataFrame, match: str) -> DataFrame:
    named = refs.withColumn("label", F.lower(label)).where(F.col("label").isNotNull())
    return asof_join(named, holders, ["label"], "event_id", "event_id", match, strict=True).drop("label")


def _touches(resolved: DataFrame) -> DataFrame:
    return resolved.where(
        F.col("type").isin(CONNECT, DISCONNECT, POSITION) & F.col("player_id").isNotNull()
    ).select("player_id", "event_id", "occurred_at", "type", "gamertag", "dayz_id")


def _players(resolved: DataFrame) -> DataFrame:
    """One row per account hash with the current label and the presence heartbeat."""
    connect_at = F.when(F.col("type") == CONNECT, F.col("event_id"))
    return (
        _touches(resolved)
        .groupBy("player_id")
        .agg(
            F.max_by("gamertag", connect_at).alias("gamertag"),
            F.max(F.when(F.col("type") == CONNECT, F.col("dayz_id"))).alias("dayz_id"),
            F.min_by("occurred_at", "event_id").alias("first_seen_at"),
            F.max_by("occurred_at", "event_id").alias("last_seen_at"),
        )
        .withColumnRenamed("player_id", "id")
    )


def _aliases(resolved: DataFrame) -> DataFrame:
    """Every label a player ever connected under: first casing, first seen, latest seen."""
    return (
        resolved.where(F.col("type") == CONNECT)
        .groupBy("player_id", F.lower("gamertag").alias("label"))
        .agg(
            F.min_by("gamertag", "event_id").alias("gamertag"),
            F.min_by("occurred_at", "event_id").alias("first_seen_at"),
            F.max("occurred_at").alias("last_seen_at"),
        )
        .drop("label")
    )


def _heartbeats(resolved: DataFrame) -> DataFrame:
    """Presence heartbeat of a player before and after each touching event, across servers."""
    return ordered_scan(
        _touches(resolved).select("player_id", "event_id", "occurred_at"),
        ["player_id"],
        ["event_id"],
        event_slice(),
        seen_before=prev(F.col("occurred_at")),
        seen_after=upto(F.col("occurred_at")),
    )


def _life_rows(resolved: DataFrame) -> DataFrame:
    """Connect and death rows of known players: ``closes`` marks the deaths that end a life.

    A life opens on a connect when none is open, so a death ends one exactly when the previous
    connect-or-death row is a connect.
    """
    rows = resolved.where(
        F.col("type").isin(CONNECT, DEATH) & F.col("player_id").isNotNull()
    ).select(
        "server_id", "player_id", "player_gamertag", "event_id", "type", "occurred_at", "victim",
        "cause", "killer", "weapon", "distance", "energy", "water", "bleed_sources",
    )
    keys = ["server_id", "player_id"]
    rows = ordered_scan(rows, keys, ["event_id"], event_slice(), __last=prev(F.col("type")))
    rows = rows.withColumn(
        "closes", (F.col("type") == DEATH) & F.coalesce(F.col("__last") == CONNECT, F.lit(False))
    ).drop("__last")
    rows = ordered_scan(
        rows, keys, ["event_id"], event_slice(),
        __ended=sum_before(F.col("closes").cast("int")),
    )
    return rows.withColumn("life_number", (F.col("__ended") + 1).cast("int")).drop("__ended")


def _bare_lives(life_rows: DataFrame) -> DataFrame:
    """Lives with the facts of the death line that ended them."""
    connect_at = F.when(F.col("type") == CONNECT, F.col("event_id"))
    death = F.struct(
        "event_id", "occurred_at", "cause", "killer", "weapon", "distance", "energy", "water",
        "bleed_sources",
    )
    return (
        life_rows.where((F.col("type") == CONNECT) | F.col("closes"))
        .groupBy("server_id", "player_id", "life_number")
        .agg(
            F.min(connect_at).alias("id"),
            F.min_by("occurred_at", connect_at).alias("started_at"),
            F.max_by(death, F.when(F.col("closes"), F.col("event_id"))).alias("death"),
        )
    )


def _late_facts(life_rows: DataFrame, bare: DataFrame) -> DataFrame:
    """Facts from further death lines at the very instant an already ended life ended."""
    extra = life_rows.where((F.col("type") == DEATH) & ~F.col("closes")).select(
        "server_id", "player_id", F.col("occurred_at").alias("ended_at"), "event_id", "cause",
        "energy", "water", "bleed_sources",
    )
    ended = bare.where(F.col("death").isNotNull()).select(
        "server_id", "player_id", F.col("death.occurred_at").alias("ended_at"), "id",
        F.col("death.event_id").alias("end_event"),
    )
    hit = extra.join(ended, ["server_id", "player_id", "ended_at"]).where(
        F.col("end_event") < F.col("event_id")
    )
    hit = (
        hit.groupBy("event_id", "cause", "energy", "water", "bleed_sources")
        .agg(F.max("id").alias("id"))
    )
    named = F.when(~F.col("cause").isin("died", "unknown"), F.col("event_id"))

    def first_known(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("event_id")))

    return hit.groupBy("id").agg(
        F.min_by("cause", named).alias("late_cause"),
        first_known("energy").alias("late_energy"),
        first_known("water").alias("late_water"),
        first_known("bleed_sources").alias("late_bleed"),
    )


def _lives(life_rows: DataFrame, bare: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Lives with death facts and the play time of their closed sessions.

    ``id`` is the opening connect, ``end_event_id`` the closing death line.
    """
    late = _late_facts(life_rows, bare)
    playtime = session_rows.groupBy(F.col("life_id").alias("id")).agg(
        F.sum("duration_seconds").alias("playtime_seconds")
    )
    cause = F.col("death.cause")
    return (
        bare.join(late, "id", "left")
        .join(playtime, "id", "left")
        .select(
            "id", "server_id", "player_id", "life_number", "started_at",
            F.col("death.occurred_at").alias("ended_at"),
            F.when((cause == "died") & F.col("late_cause").isNotNull(), F.col("late_cause"))
            .otherwise(cause).alias("death_cause"),
            F.col("death.killer").alias("death_by_gamertag"),
            F.col("death.weapon").alias("death_weapon"),
            F.col("death.distance").alias("death_distance"),
            F.coalesce("death.energy", "late_energy").alias("energy_at_death"),
            F.coalesce("death.water", "late_water").alias("water_at_death"),
            F.coalesce("death.bleed_sources", "late_bleed").alias("bleed_sources_at_death"),
            F.coalesce("playtime_seconds", F.lit(0).cast("long")).alias("playtime_seconds"),
            F.col("death.event_id").alias("end_event_id"),
        )
    )


def _session_steps(resolved: DataFrame, life_rows: DataFrame) -> DataFrame:
    """Connect rows with ``own``: the next row of the same player and server that closes it."""
    turns = life_rows.where((F.col("type") == CONNECT) | F.col("closes")).select(
        "server_id", "player_id", "event_id", "type", "occurred_at", "life_number"
    )
    leaves = resolved.where(
        (F.col("type") == DISCONNECT) & F.col("player_id").isNotNull()
    ).select("server_id", "player_id", "event_id", "type", "occurred_at")
    timeline = turns.unionByName(leaves, allowMissingColumns=True)
    step = F.struct(
        F.col("event_id"),
        F.col("occurred_at").alias("at"),
        F.when(F.col("type") == CONNECT, "superseded").otherwise("clean").alias("reason"),
    )
    return ordered_scan(
        timeline, ["server_id", "player_id"], ["event_id"], event_slice(), own=following(step)
    ).where(F.col("type") == CONNECT)


def _session_closes(opened: DataFrame, resolved: DataFrame) -> DataFrame:
    """Connect rows with ``close``: the earlier of the player's own step and the next boot."""
    boots = resolved.where(F.col("type") == BOOT).select(
        "server_id", "event_id", F.col("occurred_at").alias("at")
    )
    opened = asof_join(
        opened, boots, ["server_id"], "event_id", "event_id", "boot", direction="forward", strict=True
    )
    boot = F.when(
        F.col("boot").isNotNull(),
        F.struct(F.col("boot.event_id"), F.col("boot.at"), F.lit("reboot").alias("reason")),
    )
    return opened.withColumn("close", F.least("own", boot)).drop("own", "boot")


def _sessions(opened: DataFrame, resolved: DataFrame, bare: DataFrame) -> DataFrame:
    """Sessions: one per connect, closed by whichever comes first in the log.

    reconnect -> superseded, disconnect or life-ending death -> clean, server boot -> reboot.
    Closes the server did not vouch for are capped at the last heartbeat strictly before the
    closing event, so an offline gap never counts as play time.
    """
    capped = F.col("close.reason").isin("superseded", "reboot")
    closing = opened.where(capped).withColumn("close_event", F.col("close.event_id"))
    beats = _touches(resolved).select("player_id", "event_id", F.col("occurred_at").alias("seen"))
    closing = asof_join(
        closing, beats, ["player_id"], "close_event", "event_id", "beat", strict=True
    ).withColumn(
        "end", F.least("close.at", F.greatest("beat.seen", "occurred_at"))
    ).drop("close_event", "beat")
    rest = opened.where(F.col("close").isNull() | ~capped).withColumn("end", F.col("close.at"))

    life_of = bare.select("server_id", "player_id", "life_number", F.col("id").alias("life_id"))
    return (
        closing.unionByName(rest)
        .join(life_of, ["server_id", "player_id", "life_number"])
        .select(
            F.col("event_id").alias("id"), "server_id", "player_id", "life_id",
            F.col("occurred_at").alias("connected_at"),
            F.col("end").alias("disconnected_at"),
            duration_seconds(F.col("occurred_at"), F.col("end")).alias("__d"),
            F.col("close.reason").alias("close_reason"),
        )
        .select(
            "id", "server_id", "player_id", "life_id", "connected_at", "disconnected_at",
            F.when(F.col("disconnected_at").isNotNull(), F.col("__d")).alias("duration_seconds"),
            "close_reason",
        )
    )


def _kills(life_rows: DataFrame, bare: DataFrame, holders: DataFrame) -> DataFrame:
    """One row per life ended by another player; the killer may be unknown (null id)."""
    life_of = bare.select("server_id", "player_id", "life_number", F.col("id").alias("victim_life_id"))
    pvp = life_rows.where(
        F.col("closes")
        & (F.col("cause") == "pvp")
        & F.col("killer").isNotNull()
        & (F.col("killer") != "")
        & (F.col("killer") != F.col("victim"))
    ).join(life_of, ["server_id", "player_id", "life_number"])
    return _as_of_label(pvp, F.col("killer"), holders, "__killer").select(
        "server_id",
        F.col("killer").alias("killer_gamertag"),
        F.col("__killer.player_id").alias("killer_player_id"),
        F.col("victim").alias("victim_gamertag"),
        F.col("player_id").alias("victim_player_id"),
        "victim_life_id", "weapon", "distance", "occurred_at",
        "event_id",
    )


def _hits(resolved: DataFrame) -> DataFrame:
    """Hits, kept for unknown victims too.  Natural-key copies collapse to the first one, but a
    null attacker or body part never equals another null, so those rows are all kept."""
    rows = resolved.where(F.col("type") == HIT).select(
        "event_id", "server_id",
        F.col("victim").alias("victim_gamertag"),
        F.col("player_id").alias("victim_player_id"),
        "attacker_gamertag", "attacker_type", "attacker_label", "body_part", "victim_hp", "x", "y",
        "occurred_at",
    )
    key = [
        "server_id", "victim_gamertag", "attacker_gamertag", "attacker_type", "body_part", "occurred_at",
    ]
    whole = F.col("attacker_gamertag").isNotNull() & F.col("body_part").isNotNull()
    unique = first_by(rows.where(whole), key, [F.col("event_id")])
    return unique.unionByName(rows.where(~whole))


def _builds(resolved: DataFrame, lives_df: DataFrame) -> DataFrame:
    """Builds with the life that contained the instant; first of each natural key."""
    rows = resolved.where(F.col("type").isin(BUILD_TYPES)).select(
        "event_id", "server_id", "gamertag", "player_id", "action", "object", "class_name", "tool",
        "x", "y", "occurred_at",
    )
    known = rows.where(F.col("player_id").isNotNull())
    opened = lives_df.select(
        "server_id", "player_id", F.col("id").alias("life_id"), "started_at", "ended_at", "end_event_id"
    )
    # As-of in log order: a life still open when the build was logged holds it even when the
    # death line carries the same instant.
    known = asof_join(
        known, opened, ["server_id", "player_id"], "event_id", "life_id", "life"
    )
    holds = (
        (F.col("life.started_at") <= F.col("occurred_at"))
        & (
            F.col("life.ended_at").isNull()
            | (F.col("life.ended_at") > F.col("occurred_at"))
            | (F.col("life.end_event_id") > F.col("event_id"))
        )
    )
    known = known.withColumn("life_id", F.when(holds, F.col("life.life_id"))).drop("life")
    unknown = rows.where(F.col("player_id").isNull()).withColumn("life_id", F.lit(None).cast("long"))
    key = ["server_id", "gamertag", "action", "object", "occurred_at"]
    return first_by(known.unionByName(unknown), key, [F.col("event_id")])


def _positions(resolved: DataFrame) -> DataFrame:
    """Position fixes of known players."""
    return resolved.where((F.col("type") == POSITION) & F.col("player_id").isNotNull()).select(
        "event_id", "server_id", "player_id", F.col("player_gamertag").alias("gamertag"), "x", "y",
        F.col("occurred_at").alias("recorded_at"),
    )


def _knockouts(resolved: DataFrame) -> DataFrame:
    """Knockouts of known players, one per (server, player, instant)."""
    rows = resolved.where((F.col("type") == KNOCKOUT) & F.col("player_id").isNotNull()).select(
        "event_id", "server_id", "player_id", F.col("player_gamertag").alias("gamertag"),
        F.coalesce("disconnecting", F.lit(False)).alias("disconnecting"), "occurred_at",
    )
    return first_by(rows, ["server_id", "player_id", "occurred_at"], [F.col("event_id")])


class Projections:
    """All projections of one typed event table, each staged once and shared by its readers."""

    def __init__(self, events: DataFrame):
        self.events = events

    @cached_property
    def connects(self) -> DataFrame:
        return stage(_connects(self.events), "connects")

    @cached_property
    def holders(self) -> DataFrame:
        return stage(_holders(stage(_tenures(self.connects), "tenures")), "holders")

    @cached_property
    def resolved(self) -> DataFrame:
        return stage(_resolve(self.events, self.connects, self.holders), "resolved")

    @cached_property
    def life_rows(self) -> DataFrame:
        return stage(_life_rows(self.resolved), "life-rows")

    @cached_property
    def bare_lives(self) -> DataFrame:
        return stage(_bare_lives(self.life_rows), "bare-lives")

    @cached_property
    def players(self) -> DataFrame:
        return stage(_players(self.resolved), "players")

    @cached_property
    def player_gamertags(self) -> DataFrame:
        return stage(_aliases(self.resolved), "player-gamertags")

    @cached_property
    def heartbeats(self) -> DataFrame:
        return _heartbeats(self.resolved)

    @cached_property
    def sessions(self) -> DataFrame:
        opened = stage(_session_steps(self.resolved, self.life_rows), "session-steps")
        closes = stage(_session_closes(opened, self.resolved), "session-closes")
        return stage(_sessions(closes, self.resolved, self.bare_lives), "sessions")

    @cached_property
    def lives(self) -> DataFrame:
        return stage(_lives(self.life_rows, self.bare_lives, self.sessions), "lives")

    @cached_property
    def kills(self) -> DataFrame:
        return stage(_kills(self.life_rows, self.bare_lives, self.holders), "kills")

    @cached_property
    def hit_events(self) -> DataFrame:
        return stage(_hits(self.resolved), "hit-events")

    @cached_property
    def build_events(self) -> DataFrame:
        return stage(_builds(self.resolved, self.lives), "build-events")

    @cached_property
    def positions(self) -> DataFrame:
        return _positions(self.resolved)

    @cached_property
    def unconscious_events(self) -> DataFrame:
        return stage(_knockouts(self.resolved), "unconscious-events")

    def tables(self) -> dict[str, DataFrame]:
        """Every table; those that do not read each other are written at the same time."""
        self.holders, self.resolved  # noqa: B018
        with ThreadPoolExecutor(4) as pool:
            early = [pool.submit(getattr, self, name) for name in ("players", "player_gamertags", "hit_events", "unconscious_events")]
            self.bare_lives  # noqa: B018
            early.append(pool.submit(getattr, self, "kills"))
            self.lives  # noqa: B018
            early.append(pool.submit(getattr, self, "build_events"))
            for table in early:
                table.result()
        return {name: getattr(self, name) for name in PROJECTION_TABLES}


PROJECTION_TABLES = [
    "players", "player_gamertags", "lives", "sessions", "kills", "hit_events", "build_events",
    "positions", "unconscious_events",
]


def rebuild(events: DataFrame) -> dict[str, DataFrame]:
    """Every projection from event 0.  ``events`` is the typed, validated event table."""
    return Projections(events).tables()


def resolve_labels(events: DataFrame) -> DataFrame:
    """Add ``player_id`` (null when unknown) and ``player_gamertag`` to every player event."""
    return Projections(events).resolved


def players(events: DataFrame) -> DataFrame:
    return Projections(events).players


def aliases(events: DataFrame) -> DataFrame:
    return Projections(events).player_gamertags


def heartbeats(events: DataFrame) -> DataFrame:
    return Projections(events).heartbeats


def lives(events: DataFrame) -> DataFrame:
    return Projections(events).lives


def sessions(events: DataFrame) -> DataFrame:
    return Projections(events).sessions


def kills(events: DataFrame) -> DataFrame:
    return Projections(events).kills


def hits(events: DataFrame) -> DataFrame:
    return Projections(events).hit_events


def builds(events: DataFrame) -> DataFrame:
    return Projections(events).build_events


def positions(events: DataFrame) -> DataFrame:
    return Projections(events).positions


def knockouts(events: DataFrame) -> DataFrame:
    return Projections(events).unconscious_events
