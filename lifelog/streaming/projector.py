"""Continuous projection: each micro-batch folds its events onto what is still open.

A batch of events that all follow the earlier ones (the usual case) reads, of what came before, one row
for each person it touches and one for each (server, person): the current label, the last heartbeat, the
opening and closing lines of the last life, the open session.  Those lines and the batch are folded by the
same functions that rebuild everything, so its cost does not depend on the length of the history.

A late event - an id below one already folded - may change who held a label since.  Then the people who
ever shared a label with it are folded again from the log, and rows that come out otherwise are taken back:
tables hold the new rows and marks for those that are gone.  So every order of arrival ends in the tables
of a rebuild.

Tables, state and log are rows by version (``versions.py``): a version becomes readable at once, when all
of it is written.  A replayed batch writes the same version again, and one already readable is left out.
Broken payloads go to ``quarantine``, by version, as they came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_by
from ..projections import Projections
from ..projections import fold
from ..projections.fold import BOOT, CONNECT, DEATH, POSITION
from ..sources.payload import typed_events, validate_events
from ..staging import stage
from .versions import GONE, Pointer, Versions

#: Keys of the tables; the first column of each is an event id, so a late batch finds what it may change.
KEYS = {
    "persons": ["player_id"],
    "standing": ["player_id", "server_id"],
    "player_gamertags": ["player_id", "label"],
    "lives": ["id"], "sessions": ["id"],
    "kills": ["event_id"], "hit_events": ["event_id"], "positions": ["event_id"],
    "unconscious_events": ["event_id"], "build_events": ["event_id"],
}
#: Natural keys of which the first row counts, and the columns that must not be null for that.
FIRST = {
    "hit_events": (["server_id", "victim_gamertag", "attacker_gamertag", "attacker_type", "body_part", "occurred_at"],
                   ["attacker_gamertag", "body_part"]),
    "unconscious_events": (["server_id", "player_id", "occurred_at"], []),
    "build_events": (["server_id", "gamertag", "action", "object", "occurred_at"], []),
}
FACTS = ["kills", "hit_events", "positions", "unconscious_events", "build_events"]
#: Versions after which the tables that every batch reads are gathered.
GATHER_EVERY = 50
_GROUP = ["player_id", "server_id"]


def read_projection(spark: SparkSession, root: str, name: str, at: Pointer | None = None) -> DataFrame | None:
    """A table of the projector as of a pointer, by default the last one; None before its first row.

    A reader of several tables takes ``Versions(root).pointer(spark)`` once and passes it on.
    """
    store = Versions(root)
    at = at or store.pointer(spark)
    if name in ("quarantine", "events"):
        rows = store.rows(spark, name, at)
        return None if rows is None else rows.drop(GONE, "version", "label_bucket")
    if name == "players":
        rows = store.current(spark, "persons", KEYS["persons"], at)
        return None if rows is None else rows.select(
            F.col("player_id").alias("id"), "gamertag", "dayz_id", "first_seen_at", "last_seen_at")
    rows = store.current(spark, name, KEYS[name], at)
    return None if rows is None else rows.drop("label", "day")


def _label(event: DataFrame) -> DataFrame:
    return event.withColumn("label", F.lower(F.coalesce("gamertag", "victim")))


def _seen_day(name: str) -> Column:
    return F.to_date("recorded_at" if name == "positions" else "occurred_at")


def standing_after(life_rows: DataFrame, bare: DataFrame, sessions: DataFrame, before: DataFrame | None) -> DataFrame:
    """One row per (player, server): what a later batch needs of the lives and sessions so far.

    ``rows`` are the lines that opened and closed the last life, further death lines of that instant and the
    line of the open session; ``lives_before`` numbers the lives; ``played`` is the closed play time of the
    last life.  ``before`` is the standing that the fold began with.
    """
    last = bare.groupBy(*_GROUP).agg(F.max_by(F.struct("life_number", "id", "death"), "life_number").alias("last"))
    told = sessions.groupBy(F.col("life_id").alias("__of")).agg(F.sum("duration_seconds").alias("spent"))
    open_ = sessions.where(F.col("disconnected_at").isNull()).groupBy(*[F.col(c).alias(f"__s_{c}") for c in _GROUP]).agg(
        F.max("id").alias("open_session"))
    head = (
        last.join(told, F.col("last.id") == F.col("__of"), "left")
        .join(open_, [F.col(c) == F.col(f"__s_{c}") for c in _GROUP], "left")
        .select(*_GROUP, "last", "open_session", F.coalesce("spent", F.lit(0).cast("long")).alias("spent"))
    )
    if before is not None:
        old = before.select(*[F.col(c).alias(f"__{c}") for c in _GROUP], F.col("lives_before").alias("__before"),
                            F.col("played").alias("__played"), F.col("life_id").alias("__life"))
        head = head.join(old, [F.col(c) == F.col(f"__{c}") for c in _GROUP], "left").withColumns({
            "spent": F.col("spent") + F.when(F.col("__life") == F.col("last.id"), F.col("__played")).otherwise(0),
            "lives_before": F.coalesce("__before", F.lit(0)) + F.col("last.life_number") - 1,
        })
    else:
        head = head.withColumn("lives_before", F.col("last.life_number") - 1)
    line = F.struct(*[c for c in life_rows.columns if c not in ("closes", "life_number")])
    place = F.col("event_id")
    kept = life_rows.join(head.select(*_GROUP, "last", "open_session"), _GROUP).where(
        (place == F.col("last.id")) | (place == F.col("last.death.event_id")) | (place == F.col("open_session"))
        | ((F.col("type") == DEATH) & (place > F.col("last.death.event_id")) & (F.col("occurred_at") == F.col("last.death.occurred_at")))
    ).groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    return head.join(kept, _GROUP).select(
        *_GROUP, F.col("lives_before").cast("int").alias("lives_before"), F.col("last.id").alias("life_id"), F.col("spent").alias("played"),
        "open_session", F.transform("rows", lambda r: r["line"]).alias("rows"))


def persons_after(resolved: DataFrame, before: DataFrame | None) -> DataFrame:
    """One row per person: first and last seen, the label carried and the connect that took it."""
    touches = fold._touches(resolved)
    connect = F.struct("event_id", "gamertag")
    now = touches.groupBy("player_id").agg(
        F.max(F.when(F.col("type") == CONNECT, F.col("dayz_id"))).alias("dayz_id"),
        F.min_by("occurred_at", "event_id").alias("first_seen_at"),
        F.max_by(connect, F.when(F.col("type") == CONNECT, F.col("event_id"))).alias("claim"),
        F.max("event_id").alias("seen_event"), F.max_by("occurred_at", "event_id").alias("last_seen_at"),
    ).select("player_id", "dayz_id", "first_seen_at", F.col("claim.event_id").alias("claim_event"), F.col("claim.gamertag").alias("gamertag"),
             F.lower("claim.gamertag").alias("label"), "seen_event", "last_seen_at")
    if before is None:
        return now
    old = before.select(F.col("player_id").alias("__id"), F.struct(*[c for c in before.columns if c != "player_id"]).alias("__old"))
    known = F.col("__old").isNotNull()
    fixed = ["dayz_id", "first_seen_at"]
    return now.join(old, F.col("player_id") == F.col("__id"), "left").select(
        "player_id",
        *[F.when(known, F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) for c in fixed],
        *[F.coalesce(c, f"__old.{c}").alias(c) for c in now.columns if c not in ("player_id", *fixed)])


def aliases_after(resolved: DataFrame, before: DataFrame | None) -> DataFrame:
    now = fold._aliases(resolved).withColumn("label", F.lower("gamertag"))
    if before is None:
        return now
    both = before.withColumn("__turn", F.lit(0)).unionByName(now.withColumn("__turn", F.lit(1)))
    return both.groupBy("player_id", "label").agg(
        F.min_by("gamertag", "__turn").alias("gamertag"), F.min_by("first_seen_at", "__turn").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"), F.max("__turn").alias("__new")).where("__new = 1").drop("__new")


class _Projector:
    def __init__(self, root: str, label_buckets: int, gather_every: int = GATHER_EVERY):
        self.store, self.label_buckets, self.gather_every = Versions(root), label_buckets, gather_every

    def label_bucket(self, label: Column) -> Column:
        """Hash bucket of a label; server-wide events share bucket -1."""
        hashed = F.pmod(F.xxhash64(label), F.lit(self.label_buckets)).cast("int")
        return F.when(label.isNotNull(), hashed).otherwise(-1)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = self.store.pointer(spark)
        if batch_id <= at.version:
            return
        valid, broken = validate_events(batch)
        fresh = stage(_label(typed_events(valid)).dropDuplicates(["event_id"]), f"batch-{batch_id}")
        low, high = fresh.agg(F.min("event_id"), F.max("event_id")).first()
        late = low is not None and low <= at.high
        if late:
            fresh = self._unknown(spark, fresh, at)
        self.store.write(fresh.withColumn("label_bucket", self.label_bucket(F.col("label"))), "events", batch_id, ["label_bucket"])
        self.store.write(fresh.where(F.col("type") == CONNECT).select("dayz_id", "label").distinct(), "identities", batch_id)
        self.store.write(broken, "quarantine", batch_id)
        changes = self._refold(spark, fresh, at, batch_id) if late else self._advance(spark, fresh, at)
        for name, rows in changes.items():
            partition = ["day"] if name in FIRST else []
            self.store.write(rows.withColumn("day", _seen_day(name)) if partition else rows, name, batch_id, partition)
        now = Pointer(batch_id, at.base, max(at.high, high if high is not None else -1))
        if batch_id - max(at.base, 0) >= self.gather_every:
            for name in ("persons", "standing", "player_gamertags"):
                self.store.gather(spark, name, KEYS[name], now)
            now = Pointer(now.version, now.version, now.high)
        self.store.publish(spark, now)

    # --- events that follow all earlier ones ------------------------------------------------------

    def _advance(self, spark: SparkSession, fresh: DataFrame, at: Pointer) -> dict[str, DataFrame]:
        """New and changed rows of every table, from the batch and the standing of those it touches."""
        persons = self.store.current(spark, "persons", KEYS["persons"], at)
        labels = fresh.where(F.col("label").isNotNull()).select("label").unionByName(
            fresh.where(F.col("killer").isNotNull()).select(F.lower("killer").alias("label"))).distinct()
        events = fresh.drop("label")
        new = fold._connects(events)
        claims = None
        if persons is not None:
            persons = stage(persons, "persons")
            known = persons.select(F.col("dayz_id").alias("__hash"), F.col("player_id").alias("__known"), F.col("label").alias("__label"))
            joined = stage(new.join(known, F.col("dayz_id") == F.col("__hash"), "left"), "connects")
            labels = labels.unionByName(joined.where(F.col("__label").isNotNull()).select(F.col("__label").alias("label"))).distinct()
            new = joined.withColumn("player_id", F.coalesce("__known", "player_id")).drop("__hash", "__known", "__label")
            claims = persons.join(labels, "label", "left_semi").select(F.col("claim_event").alias("event_id"), "player_id", "gamertag")
        new = stage(new, "connects")
        carried = new.select("event_id", "player_id", "gamertag")
        holders = stage(fold._holders(stage(fold._tenures(carried if claims is None else carried.unionByName(claims)), "tenures")), "holders")
        resolved = stage(fold._resolve(events, new, holders), "resolved")

        groups = resolved.where(F.col("player_id").isNotNull()).select(*_GROUP).distinct()
        standing = self.store.current(spark, "standing", KEYS["standing"], at)
        memory = before = None
        if standing is not None:
            boots = fresh.where(F.col("type") == BOOT).select("server_id").distinct()
            closed = standing.where(F.col("open_session").isNotNull()).join(boots, "server_id", "left_semi").select(*_GROUP)
            groups = stage(groups.union(closed).distinct(), "groups")
            before = stage(standing.join(groups, _GROUP, "left_semi"), "standing")
            seen = persons.join(groups.select("player_id").distinct(), "player_id", "left_semi").select(
                "player_id", F.col("seen_event").alias("event_id"), F.col("last_seen_at").alias("occurred_at"), F.lit(POSITION).alias("type"))
            memory = before.select(F.inline("rows")).unionByName(seen, allowMissingColumns=True)
        folded = Projections(events)
        folded.__dict__.update(
            connects=new, holders=holders,
            resolved=resolved if memory is None else stage(resolved.unionByName(memory, allowMissingColumns=True), "resolved"))

        sessions, played, numbers = folded.sessions, None, None
        if before is not None:  # sessions that ended earlier are not told again
            sessions = stage(sessions.join(before.select(F.col("open_session").alias("id")).where("id IS NOT NULL").withColumn(
                "__open", F.lit(True)), "id", "left").where((F.col("id") > at.high) | F.col("__open")).drop("__open"), "sessions")
            played = before.select("life_id", F.col("played").alias("duration_seconds"))
            numbers = before.select(*_GROUP, F.col("lives_before").alias("__before"))
        spent = sessions.select("life_id", "duration_seconds")
        lives = stage(fold._lives(folded.life_rows, folded.bare_lives, spent if played is None else spent.unionByName(played)), "lives")
        folded.__dict__.update(sessions=sessions, lives=lives)
        if numbers is not None:
            lives = lives.join(numbers, _GROUP, "left").withColumn(
                "life_number", (F.col("life_number") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__before").select(*lives.columns)

        touched = resolved.select("player_id").where("player_id IS NOT NULL").distinct()
        aliases = self.store.current(
            spark, "player_gamertags", KEYS["player_gamertags"], at, lambda rows: rows.join(touched, "player_id", "left_semi"))
        changes = {
            "persons": persons_after(resolved, persons),
            "player_gamertags": aliases_after(resolved, aliases),
            "standing": standing_after(folded.life_rows, folded.bare_lives, sessions, before),
            "lives": lives, "sessions": sessions,
        }
        for name in FACTS:
            rows = getattr(folded, name).where(F.col("event_id") > at.high)
            if name in FIRST:
                rows = self._first(spark, rows, name, at)
            changes[name] = rows
        return changes

    def _first(self, spark: SparkSession, rows: DataFrame, name: str, at: Pointer) -> DataFrame:
        """Rows whose natural key has no earlier row; only the days of the batch are read."""
        keys, whole = FIRST[name]
        days = [r[0] for r in rows.select(_seen_day(name).alias("d")).distinct().collect()]  # days, not rows
        older = self.store.current(spark, name, KEYS[name], at, lambda stored: stored.where(F.col("day").isin(days)))
        if older is None:
            return rows
        rows = stage(rows, name)
        told = reduce(Column.__and__, [F.col(c).isNotNull() for c in whole], F.lit(True))
        return rows.where(told).join(older.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(rows.where(~told))

    # --- late events ------------------------------------------------------------------------------

    def _unknown(self, spark: SparkSession, fresh: DataFrame, at: Pointer) -> DataFrame:
        """Events that the log does not hold yet."""
        # At most label_buckets numbers; the scan reads those buckets of the log only.
        buckets = [r[0] for r in fresh.select(self.label_bucket(F.col("label"))).distinct().collect()]
        stored = self.store.rows(spark, "events", at)
        return stage(fresh.join(stored.where(F.col("label_bucket").isin(buckets)).select("event_id"), "event_id", "left_anti"), "batch")

    def _refold(self, spark: SparkSession, fresh: DataFrame, at: Pointer, batch_id: int) -> dict[str, DataFrame]:
        """Changes of every table after the people around late events are folded again from the log."""
        here = Pointer(batch_id, at.base, at.high)
        identities = self.store.rows(spark, "identities", here).select("dayz_id", "label").distinct()
        labels = self._closure(spark, fresh, identities, at)
        log = self.store.rows(spark, "events", here).drop(GONE, "version")

        def events_of(wanted: DataFrame) -> DataFrame:
            buckets = [r[0] for r in wanted.select(self.label_bucket(F.col("label"))).distinct().collect()]
            return log.where(F.col("label_bucket").isin(buckets)).join(wanted, "label", "left_semi").drop("label", "label_bucket")

        boots = log.where((F.col("label_bucket") == -1) & (F.col("type") == BOOT)).drop("label", "label_bucket")
        mine = stage(events_of(labels).unionByName(boots), "refold")
        # Killers may be others: who held their labels takes the connects of all who share them.
        killers = mine.where(F.col("killer").isNotNull()).select(F.lower("killer").alias("label")).distinct()
        sharing = identities.join(killers, "label", "left_semi").select("dayz_id").distinct()
        wider = labels.unionByName(identities.join(sharing, "dayz_id", "left_semi").select("label")).unionByName(killers).distinct()
        connects = stage(fold._connects(events_of(stage(wider, "labels")).where(F.col("type") == CONNECT)), "connects")
        folded = Projections(mine)
        folded.__dict__["holders"] = stage(fold._holders(stage(fold._tenures(connects), "tenures")), "holders")

        tables = {
            "persons": persons_after(folded.resolved, None),
            "player_gamertags": aliases_after(folded.resolved, None),
            "standing": standing_after(folded.life_rows, folded.bare_lives, folded.sessions, None),
            "lives": folded.lives, "sessions": folded.sessions,
        } | {name: getattr(folded, name) for name in FACTS}
        ids = stage(mine.select("event_id").unionByName(fresh.select("event_id")).distinct(), "refold-ids")
        changes = {name: self._changed(spark, rows, name, at, ids) for name, rows in tables.items()}

        # Kills of people outside, by a name that someone else may have held now.
        kills = self.store.current(
            spark, "kills", KEYS["kills"], at,
            lambda stored: stored.join(ids, "event_id", "left_anti").join(labels, F.lower("killer_gamertag") == F.col("label"), "left_semi"))
        if kills is not None:
            again = fold._as_of_label(kills, F.col("killer_gamertag"), folded.holders, "__killer")
            moved = again.where(~F.col("killer_player_id").eqNullSafe(F.col("__killer.player_id"))).withColumn(
                "killer_player_id", F.col("__killer.player_id")).select(*kills.columns)
            changes["kills"] = changes["kills"].unionByName(moved.withColumn(GONE, F.lit(False)), allowMissingColumns=True)
        return changes

    def _changed(self, spark: SparkSession, rows: DataFrame, name: str, at: Pointer, ids: DataFrame) -> DataFrame:
        """Rows of a refold that are new or other than the stored ones, and marks for stored keys without a row."""
        keys = KEYS[name]
        mine = ids.withColumnRenamed("event_id", keys[0])
        stored = self.store.current(spark, name, keys, at, lambda old: old.join(mine, keys[0], "left_semi"))
        if stored is None:
            return rows
        rest = [c for c in rows.columns if c not in keys]
        new = rows.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__has"))
        old = stored.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__had"))
        both = stage(new.join(old, keys, "full").where(~F.col("__new").eqNullSafe(F.col("__old"))), f"changed-{name}")
        row = F.coalesce("__new", "__old")
        return both.select(*keys, *[row[c].alias(c) for c in rest], F.col("__has").isNull().alias(GONE))

    def _closure(self, spark: SparkSession, fresh: DataFrame, identities: DataFrame, at: Pointer) -> DataFrame:
        """Labels of the batch, of people whose sessions a boot may close, and of everyone sharing a label."""
        labels = fresh.where(F.col("label").isNotNull()).select("label").unionByName(
            fresh.where(F.col("killer").isNotNull()).select(F.lower("killer").alias("label"))
        )
        boots = fresh.where(F.col("type") == BOOT).groupBy("server_id").agg(F.max("event_id").alias("boot"))
        sessions = self.store.current(spark, "sessions", KEYS["sessions"], at)
        if sessions is not None:
            # A late boot may end any session that began before it.
            out = sessions.join(boots, "server_id").where(F.col("id") < F.col("boot")).select("player_id").distinct()
            persons = self.store.current(spark, "persons", KEYS["persons"], at)
            hashes = persons.join(out, "player_id", "left_semi").select("dayz_id")
            labels = labels.unionByName(identities.join(hashes, "dayz_id", "left_semi").select("label"))
        labels = stage(labels.distinct(), "labels")
        size = labels.count()
        while True:
            people = identities.join(labels, "label", "left_semi").select("dayz_id").distinct()
            wider = identities.join(people, "dayz_id", "left_semi").select("label")
            labels = stage(labels.unionByName(wider).distinct(), "labels")
            grown = labels.count()
            if grown == size:
                return labels
            size = grown


def run_projector(
    events: DataFrame,
    root: str,
    checkpoint: str,
    *,
    label_buckets: int = 4096,
    gather_every: int = GATHER_EVERY,
    available_now: bool = True,
):
    """Start the projector on a stream of JSON-payload events; returns the streaming query."""
    writer = events.writeStream.foreachBatch(_Projector(root, label_buckets, gather_every)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
