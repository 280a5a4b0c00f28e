"""The library's tables derived from the driver tables, see FIXTURES.md section 3."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.functions.scalars import instant
from lifelog.operators.ordered import event_slice, ordered_scan, running_sum
from lifelog.projections import Projections
from lifelog.queries import Dataset
from lifelog.sources.extract import assign_timestamps
from lifelog.sources.payload import typed_events
from lifelog.staging import stage, stage_root
from lifelog.streaming import run_projector

NOW = datetime(2024, 1, 31)
SINCE = datetime(2024, 1, 10)
QUALIFY = 43_200
GAP = 21_600
RECENT = 21_600
FRESH = 43_200


def ntz(df: DataFrame) -> DataFrame:
    """Instants as zone-less timestamps, the type the driver tables use."""
    return df.select(
        *[F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    )


def _payload(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}
    )


class World:
    """Lazily built tables of one scale-factor directory; projections are staged once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(
            *[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
        )

    # --- event log -----------------------------------------------------------------------

    @cached_property
    def source(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").alias("at"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            (1 + (F.col("user_id") + F.col("event_id")) % 3).cast("int").alias("server_id"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """The driver's events as an event log with JSON payloads."""
        kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
        label = F.concat(F.lit("P"), F.col("user_id").cast("string"))
        other = F.concat(F.lit("P"), (F.col("user_id") + 1 + k % 5).cast("string"))
        none = F.lit(None)
        event_type = (
            F.when(kind == "signup", "player.connected")
            .when((kind == "purchase") & (k % 20 == 0), "server.rebooted")
            .when(kind == "purchase", "player.disconnected")
            .when(kind == "error", "player.died")
            .when((kind == "view") & (k % 10 == 9), "player.unconscious")
            .when((kind == "view") & (k % 10 == 8), "build.placed")
            .when(kind == "view", "player.position")
            .otherwise("player.hit")
        )
        pvp = k % 2 == 0
        cause = (
            F.when(pvp, "pvp").when(k % 10 == 1, "suicide").when(k % 10 == 3, "bled_out")
            .when(k % 10 == 5, "wolf").when(k % 10 == 7, "died").otherwise("environment")
        )
        weapon = F.when(k % 3 == 0, "M4A1").when(k % 3 == 1, "Hunting Knife").otherwise("SKS")
        attacker = F.when(k % 3 == 0, "player").when(k % 3 == 1, "infected").otherwise("environment")
        thing = (
            F.when(k % 5 == 0, "FireplaceBase").when(k % 5 == 1, "Animal_CanisLupus_Grey")
            .when(k % 5 == 2, "FallDamageHealth").when(k % 5 == 3, "Animal_UrsusArctos")
            .otherwise("BarbedWire")
        )
        x, y = value * 30, (k * 150).cast("double")
        payload = (
            F.when(event_type.isin("player.connected", "player.disconnected"),
                   _payload(gamertag=label, dayzId=F.concat(F.lit("H"), F.col("user_id").cast("string"))))
            .when(event_type == "server.rebooted", _payload(localDateTime=F.col("at").cast("string")))
            .when(event_type == "player.died", _payload(
                victim=label, cause=cause, killer=F.when(pvp, other), weapon=F.when(pvp, weapon),
                distance=F.when(pvp, value), energy=F.when(~pvp, (k % 4).cast("double")),
                water=F.when(~pvp, (k % 6).cast("double")), bleedSources=F.when(~pvp, k % 3)))
            .when(event_type == "player.unconscious",
                  _payload(gamertag=label, disconnecting=k % 20 == 9, x=x, y=y))
            .when(event_type == "build.placed",
                  _payload(gamertag=label, action=F.lit("placed"),
                           object=F.concat(F.lit("Fence"), (k % 7).cast("string")),
                           className=none.cast("string"), tool=none.cast("string"), x=x, y=y))
            .when(event_type == "player.position", _payload(gamertag=label, x=x, y=y))
            .otherwise(_payload(
                victim=label, victimHp=value, attackerType=attacker,
                attackerGamertag=F.when(attacker == "player", other),
                attackerLabel=F.when(attacker == "infected", "Infected")
                .when(attacker == "environment", thing),
                bodyPart=F.when(k % 4 != 0, "Torso"), x=x, y=y))
        )
        return self.source.select(
            "event_id", "server_id", event_type.alias("type"), F.col("at").alias("occurred_at"),
            payload.alias("payload"),
        )

    @cached_property
    def typed(self) -> DataFrame:
        return stage(typed_events(self.events), "typed-events")

    @cached_property
    def streamed(self) -> str:
        """Folder of the projector after three batches: most early events, all later ones, the early ones left out."""
        folder = f"{stage_root(self.spark)}/lifelog-stream-{uuid.uuid4().hex}"
        cut = self.events.agg(F.percentile_approx("event_id", 0.7)).first()[0]
        early = F.col("event_id") <= cut
        late = early & (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
        again = early & (F.pmod(F.xxhash64("event_id"), F.lit(50)) == 1)
        for part in (early & ~late, ~early, late | again):
            self.events.where(part).repartition(2, "event_id").write.mode("append").parquet(f"{folder}/in")
            stream = self.spark.readStream.schema(self.events.schema).parquet(f"{folder}/in")
            run_projector(stream, f"{folder}/out", f"{folder}/cursor", label_buckets=8).awaitTermination()
        return f"{folder}/out"

    @cached_property
    def projections(self) -> Projections:
        return Projections(self.typed)

    @cached_property
    def renamed(self) -> Projections:
        """The same events where people share and change their labels: 25 labels go round."""
        label = F.concat(F.lit("N"), ((F.col("user_id") * 3 + F.col("k")) % 25).cast("string"))
        names = self.source.select("event_id", label.alias("__label"))
        swapped = self.typed.join(names, "event_id").withColumns({
            c: F.when(F.col(c).isNotNull(), F.col("__label")) for c in ("gamertag", "victim")})
        return Projections(stage(swapped.select(*self.typed.columns), "renamed-events"))

    @cached_property
    def renamed_links(self) -> DataFrame:
        u = F.col("id")
        return self.links.withColumn("gamertag", F.concat(F.lit("n"), (u % 30).cast("string")))

    @cached_property
    def renamed_bans(self) -> DataFrame:
        return self.bans.withColumn("gamertag", F.concat(F.lit("N"), (F.expr("id div 2") % 28).cast("string")))

    # --- log text --------------------------------------------------------------------------

    @cached_property
    def log_lines(self) -> DataFrame:
        """The events written as server log lines, one endless file per server.

        ``file, line_index, text, started_at, server_id, event_id``; line 0 is a boot header.
        """
        k, u = F.col("k"), F.col("user_id").cast("string")
        two = lambda c: F.format_string("%.2f", c)
        pos = F.concat(F.lit("pos=<"), two(F.col("value") * 30), F.lit(", "), two((k * 150).cast("double")), F.lit(", 1.0>"))
        who = F.concat(F.lit('Player "P'), u, F.lit('" (id=H'), u, F.lit(" "), pos, F.lit(")"))
        dead = F.concat(F.lit('Player "P'), u, F.lit('" (DEAD) (id=H'), u, F.lit(" "), pos, F.lit(")"))
        foe = (F.col("user_id") + 1 + k % 5).cast("string")
        enemy = F.concat(F.lit('Player "P'), foe, F.lit('" (id=H'), foe, F.lit(" pos=<1.0, 1.0, 1.0>)"))
        weapon = F.when(k % 3 == 0, "M4A1").when(k % 3 == 1, "Hunting Knife").otherwise("SKS")
        end = (
            F.when(k % 2 == 0, F.concat(F.lit(" killed by "), enemy, F.lit(" with "), weapon, F.lit(" from "),
                                        two(F.col("value")), F.lit(" meters")))
            .when(k % 10 == 1, " committed suicide").when(k % 10 == 3, " bled out")
            .when(k % 10 == 5, " killed by Animal_CanisLupus_Grey")
            .when(k % 10 == 7, F.concat(F.lit(" died. Stats> Water: "), (k % 6).cast("string"), F.lit(" Energy: "),
                                        (k % 4).cast("string"), F.lit(" Bleed sources: "), (k % 3).cast("string")))
            .otherwise(" killed by BarbedWire")
        )
        source = (
            F.when(k % 3 == 0, enemy).when(k % 3 == 1, "Infected").when(k % 5 == 0, "FireplaceBase")
            .when(k % 5 == 2, "FallDamageHealth").otherwise("BarbedWire")
        )
        hit = F.concat(who, F.lit("[HP: "), two(F.col("value")), F.lit("] hit by "), source,
                       F.when(k % 4 != 0, F.lit(" into Torso(3)")).otherwise(""), F.lit(" for 1.5 damage"))
        kind = F.col("type")
        body = (
            F.when(kind == "player.connected", F.concat(who, F.lit(" is connected")))
            .when(kind == "player.disconnected", F.concat(who, F.lit(" has been disconnected")))
            .when(kind == "player.died", F.concat(dead, end))
            .when(kind == "player.hit", hit)
            .when(kind == "player.unconscious", F.concat(who, F.lit(" is unconscious")))
            .when(kind == "build.placed", F.concat(who, F.lit("placed Fence"), (k % 7).cast("string")))
            .otherwise(who)
        )
        clock = F.date_format("at", "HH:mm:ss")
        text = F.when(
            kind == "server.rebooted",
            F.concat(F.lit("AdminLog started on "), F.date_format("at", "yyyy-MM-dd"), F.lit(" at "), clock),
        ).otherwise(F.concat(clock, F.lit(" | "), body))
        rows = self.source.join(self.events.select("event_id", "type"), "event_id").select(
            "event_id", "server_id", F.concat(F.lit("server-"), F.col("server_id").cast("string")).alias("file"),
            text.alias("text"),
        )
        numbered = ordered_scan(rows, ["file"], ["event_id"], event_slice(), n=running_sum(F.lit(1).cast("long")))
        lines = numbered.select("event_id", "server_id", "file", F.col("n").cast("int").alias("line_index"), "text")
        headers = self.servers.select(
            F.lit(None).cast("long").alias("event_id"), F.col("id").alias("server_id"),
            F.concat(F.lit("server-"), F.col("id").cast("string")).alias("file"), F.lit(0).alias("line_index"),
            F.lit("AdminLog started on 2024-01-01 at 00:00:00").alias("text"),
        )
        return stage(
            lines.unionByName(headers).withColumn("started_at", instant(datetime(2024, 1, 1))),
            "log-lines",
        )

    @cached_property
    def varied_lines(self) -> DataFrame:
        """One log line per event, of the kinds that ``log_lines`` has none of: (event_id, text)."""
        k, u = F.col("k"), F.col("user_id").cast("string")
        two = lambda c: F.format_string("%.2f", c)
        pos = F.concat(F.lit("pos=<"), two(F.col("value")), F.lit(", "), two(k.cast("double")), F.lit(", 1.0>"))
        player = lambda mark, place: F.concat(F.lit('Player "P'), u, F.lit(f'"{mark} (id=H'), u, F.lit(" "), place, F.lit(")"))
        who, dead = player("", pos), player(" (DEAD)", pos)
        bare = F.concat(F.lit('Player "P'), u, F.lit('" (id=H'), u, F.lit(")"))
        texts = [
            F.concat(F.lit("##### PlayerList log: "), k.cast("string"), F.lit(" players")),
            F.concat(bare, F.lit(" is connecting")),
            F.concat(dead, F.lit(" drowned")),
            F.concat(dead, F.lit(" killed by ZmbM_CitizenASkinny")),
            F.concat(dead, F.lit(" killed by FallDamage")),
            F.concat(dead, F.lit(" killed by CivilianSedan")),
            F.concat(dead, F.lit(" killed by Animal_UrsusArctos")),
            F.concat(who, F.lit("[HP: "), two(F.col("value")), F.lit("] hit by Infected into Head(0) for "), two(k * 0.5), F.lit(" damage (Melee)")),
            F.concat(who, F.lit(" Dismantled Wall"), k.cast("string"), F.lit("<Fence> with Pliers")),
            F.concat(who, F.lit(" performed EmoteSalute with Rag")),
            F.concat(who, F.lit(" was teleported from: <1.5, 2.5, 3.5> to: <4.5, "), k.cast("string"), F.lit(".5, 6.5>. Reason: admin call")),
            player("", F.lit("pos=<3.4e38, 5.0, 1.0>")),
            F.concat(who, F.lit(" is disconnecting while being unconscious")),
            player("", F.lit("pos=<-5000.0, 5.0, 1.0>")),
            dead,
            F.concat(who, F.lit(" has been disconnected")),
        ]
        clock = F.concat(F.date_format("at", "HH:mm:ss"), F.lit(" | "))
        text = F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int"))
        return self.source.select("event_id", F.concat(clock, text).alias("text"))

    @cached_property
    def log_folder(self) -> str:
        """The log lines as files: one .ADM file per server below ``server_id=N``."""
        folder = f"{stage_root(self.spark)}/lifelog-files-{uuid.uuid4().hex}"
        # One file per server needs its lines in one task each; the files are the fixture, not the operator.
        for server in (1, 2, 3):
            lines = self.log_lines.where(F.col("server_id") == server).orderBy("line_index").select("text").coalesce(1)
            lines.write.text(f"{folder}/raw/server_id={server}")
        return self._named(folder)

    @cached_property
    def damaged_folder(self) -> str:
        """The log files again, that of server 2 with bytes that are no text at its end."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = f"{stage_root(self.spark)}/lifelog-files-{uuid.uuid4().hex}"
        source, target = jvm.org.apache.hadoop.fs.Path(self.log_folder), jvm.org.apache.hadoop.fs.Path(folder)
        fs = source.getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, conf)
        extra = fs.create(jvm.org.apache.hadoop.fs.Path(target, "server_id=2/DayZServer_X1_x64_2024-02-01_00-00-00.ADM"))
        extra.write(bytearray(b"AdminLog started on 2024-02-01 at 00:00:00\n00:00:01 | \xff\xfe\x80 broken\n"))
        extra.close()
        return folder

    def _named(self, folder: str) -> str:
        """Give the part files the names that the game gives its logs."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for server in (1, 2, 3):
            source = jvm.org.apache.hadoop.fs.Path(f"{folder}/raw/server_id={server}")
            fs = source.getFileSystem(conf)
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/logs/server_id={server}")
            fs.mkdirs(target)
            for status in fs.listStatus(source):
                if status.getPath().getName().startswith("part-"):
                    fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(
                        target, f"DayZServer_X1_x64_2024-01-0{server}_00-00-00.ADM"))
        return f"{folder}/logs"

    @cached_property
    def stamped_lines(self) -> DataFrame:
        return stage(assign_timestamps(self.log_lines), "stamped-lines")

    @cached_property
    def raw_lines(self) -> DataFrame:
        return self.stamped_lines.where(F.col("event_id").isNotNull()).select(
            F.col("event_id").alias("raw_line_id"), "server_id", F.col("server_id").cast("long").alias("file_id"),
            "line_index", "occurred_at", "text",
        )

    @cached_property
    def vague_deaths(self) -> DataFrame:
        """Death events that still carry the bare cause and no vitals."""
        blank = _payload(victim=F.lit("V"), cause=F.lit("died"), killer=F.lit(None).cast("string"),
                         weapon=F.lit(None).cast("string"), distance=F.lit(None).cast("double"))
        return self.events.where(F.col("type") == "player.died").select(
            "event_id", "server_id", "type", "occurred_at", blank.alias("payload"),
            F.col("event_id").alias("raw_line_id"),
        )

    @cached_property
    def day_files(self) -> DataFrame:
        """One log file per server and day."""
        day = F.date_trunc("day", "at")
        return self.source.groupBy("server_id", day.alias("started_at")).agg(
            F.max("at").alias("last_at"), F.count("*").cast("int").alias("n")
        ).select(
            "server_id", F.concat_ws("-", F.lit("f"), F.col("server_id").cast("string"),
                                     F.date_format("started_at", "yyyyMMdd")).alias("file"),
            "started_at", (F.col("last_at") + F.expr("interval 5 hours")).alias("modified_at"), "n",
        )

    @cached_property
    def day_cursor(self) -> DataFrame:
        """The first ten days are loaded."""
        return self.day_files.where(F.col("started_at") < instant(datetime(2024, 1, 11))).select(
            "file", F.col("n").alias("last_processed_line"), F.lit(True).alias("is_complete")
        )

    # --- side tables ---------------------------------------------------------------------

    @cached_property
    def servers(self) -> DataFrame:
        sid = F.col("server_id")
        return self.source.select("server_id").distinct().select(
            sid.alias("id"), F.concat(F.lit("Server "), sid.cast("string")).alias("name"),
            F.when(sid == 1, "chernarusplus").when(sid == 2, "sakhal").otherwise("enoch").alias("map"),
            F.when(sid == 1, "chernarus").when(sid == 2, "sakhal").otherwise("livonia").alias("slug"),
            (sid != 3).alias("active"), F.lit(0).cast("long").alias("clock_offset_ms"),
        )

    @cached_property
    def links(self) -> DataFrame:
        u = F.col("user_id")
        users = self.source.groupBy("user_id").agg(F.min("at").alias("created_at"))
        status = F.when(u % 4 == 0, "pending").otherwise("verified")
        return users.select(
            u.alias("id"), F.concat(F.lit("U"), u.cast("string")).alias("user_id"),
            F.concat(F.when(u % 2 == 0, "P").otherwise("p"), u.cast("string")).alias("gamertag"),
            status.alias("status"),
            F.when(status == "verified", F.col("created_at") + F.expr("interval 1 hour")).alias("verified_at"),
            "created_at",
        )

    @cached_property
    def avatars(self) -> DataFrame:
        return self.links.where(F.col("id") % 3 != 0).select(
            "user_id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash")
        )

    @cached_property
    def named_lives(self) -> DataFrame:
        names = self.projections.players.select(F.col("id").alias("player_id"), "gamertag", "dayz_id")
        return self.projections.lives.join(names, "player_id")

    @cached_property
    def bans(self) -> DataFrame:
        i = F.col("id")
        step = F.expr("(id div 2) % 5")
        status = (
            F.when(step == 0, "pending").when(step == 1, "applied").when(step == 2, "lift_pending")
            .when(step == 3, "expired").otherwise("lifted")
        )
        until = F.col("ended_at") + F.expr("interval 24 hours")
        return self.named_lives.where(F.col("ended_at").isNotNull() & (i % 2 == 0)).select(
            "id", "server_id", "gamertag", "dayz_id", F.col("started_at").alias("life_started_at"),
            F.lit("kill").alias("qualified_by"), F.col("ended_at").alias("banned_at"),
            until.alias("expires_at"), status.alias("status"), (i % 7 == 0).alias("dry_run"),
            F.when(step >= 3, until).alias("lifted_at"), F.col("ended_at").alias("created_at"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        i = F.col("id")
        places = self.servers.select(F.col("id").alias("server_id"), "map", F.col("slug").alias("map_slug"))
        rows = self.named_lives.where(F.col("ended_at").isNotNull() & (i % 3 == 0)).join(places, "server_id")
        facts = _payload(
            sessions=F.col("life_number"), killerGamertag=F.col("death_by_gamertag"),
            verdict=F.when(i % 2 == 0, F.struct(F.col("death_cause").alias("cause"))),
        )
        return rows.select(
            "id", F.lit("obituary").alias("kind"),
            F.when(i % 9 == 0, "failed").otherwise("published").alias("status"),
            F.concat(F.lit("obit-"), i.cast("string")).alias("slug"), "server_id",
            F.when(i % 30 != 0, F.col("gamertag")).alias("gamertag"), "map", "map_slug", "life_number",
            F.col("started_at").alias("life_started_at"), F.col("ended_at").alias("death_at"),
            F.concat(F.lit("Death of "), F.col("gamertag")).alias("headline"),
            F.concat(F.lit("Life "), F.col("life_number").cast("string"), F.lit(" is over. It counted.")).alias("lede"),
            F.lit("Body").alias("body"), F.array(F.lit("Obituaries")).alias("tags"),
            F.col("playtime_seconds").alias("time_alive_seconds"), F.lit(0).alias("kills"),
            F.lit(None).cast("double").alias("longest_kill_meters"), F.col("death_cause").alias("cause"),
            F.lit(None).cast("string").alias("pull_quote_text"),
            F.lit(None).cast("string").alias("pull_quote_attribution"), facts.alias("facts"),
            F.lit(None).cast("string").alias("body_blocks"), (i % 5).cast("int").alias("attempts"),
            (F.col("ended_at") + F.expr("interval 1 hour")).alias("created_at"),
        )

    @cached_property
    def syndications(self) -> DataFrame:
        i = F.col("id")
        return self.articles.where(i % 2 == 0).select(
            "slug", F.when(i % 4 == 0, "chat").otherwise("social").alias("channel"),
            F.when(i % 8 != 0, F.col("created_at")).alias("posted_at"), (i % 4).cast("int").alias("attempts"),
        )

    @cached_property
    def shares(self) -> DataFrame:
        owner = self.projections.players.select(
            F.col("id").alias("player_id"), F.expr("cast(substring(gamertag, 2) as bigint)").alias("u")
        )
        latest = self.projections.sessions.where(F.col("id") % 2 == 0).groupBy("server_id", "player_id").agg(
            F.max("connected_at").alias("granter_session_connected_at")
        )
        return latest.join(owner, "player_id").select(
            F.concat(F.lit("U"), F.col("u").cast("string")).alias("granter_user_id"),
            F.concat(F.lit("U"), (F.col("u") + 1).cast("string")).alias("grantee_user_id"),
            "server_id", "granter_session_connected_at",
        )

    @cached_property
    def notifications(self) -> DataFrame:
        k = F.col("k")
        u = F.col("user_id").cast("string")
        return self.source.select(
            F.col("event_id").alias("id"), F.concat(F.lit("U"), u).alias("user_id"),
            F.col("event_type").alias("kind"),
            F.concat_ws(":", F.col("event_type"), u, k.cast("string")).alias("natural_key"),
            F.lit("T").alias("title"), F.lit("B").alias("body"), F.lit("/").alias("href"),
            F.col("at").alias("created_at"), F.when(k % 2 == 0, F.col("at")).alias("read_at"),
            F.when(k % 3 == 0, F.col("at")).alias("pushed_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.links.where(F.col("id") % 3 == 0).select(
            "id", "user_id", F.concat(F.lit("https://push/"), F.col("id").cast("string")).alias("endpoint"),
            (F.col("id") % 6).cast("int").alias("failure_count"),
            F.when(F.col("id") % 5 == 0, F.col("created_at")).alias("disabled_at"),
        )

    @cached_property
    def emotes(self) -> DataFrame:
        return self.source.where(F.col("event_type") == "click").select(
            "event_id", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("gamertag"),
            F.concat(F.lit("E"), (F.col("k") % 5).cast("string")).alias("emote"),
            F.col("at").alias("occurred_at"),
        )

    @cached_property
    def rival_links(self) -> DataFrame:
        """Two pending links per label; labels of every seventh user already have an owner."""
        users = self.source.select("user_id").distinct().select(
            "user_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
        )
        u, i = F.col("user_id"), F.col("i")
        return users.where((i < 2) | (u % 7 == 0)).select(
            (u * 3 + i).alias("id"), F.concat_ws("-", u.cast("string"), i.cast("string")).alias("user_id"),
            F.concat(F.lit("P"), u.cast("string")).alias("gamertag"),
            F.when(i == 2, "verified").otherwise("pending").alias("status"),
            F.lit(None).cast("timestamp").alias("verified_at"),
            instant(SINCE).alias("created_at"),
        )

    @cached_property
    def challenges(self) -> DataFrame:
        i, u = F.col("id") % 3, F.expr("id div 3")
        token = lambda n: F.concat(F.lit("E"), (n % 5).cast("string"))
        return self.rival_links.where(F.col("status") == "pending").select(
            "id", F.col("id").alias("gamertag_link_id"),
            F.when(i == 0, F.array(token(u), token(u + 1), token(u + 2)))
            .otherwise(F.array(token(u + 1), token(u))).alias("sequence"),
            F.lit(0).alias("progress_index"), F.lit(0).cast("long").alias("last_matched_event_id"),
            instant(datetime(2024, 1, 5)).alias("issued_at"),
            instant(datetime(2024, 1, 25)).alias("expires_at"),
            F.lit(None).cast("timestamp").alias("completed_at"),
        )

    # --- customers, orders, documents ------------------------------------------------------

    @cached_property
    def ledger(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("user_id"),
            F.when(s == "P", -1).otherwise(1).alias("delta"),
            F.when(s == "P", "redeem").when(s == "F", "monthly").otherwise("verification").alias("kind"),
            F.concat(F.lit("verify:"), F.col("o_orderkey").cast("string")).alias("idempotency_key"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        """Label links of the customers."""
        c = F.col("c_custkey")
        return self.raw("customer").select(
            c.alias("id"), F.concat(F.lit("C"), c.cast("string")).alias("user_id"),
            F.col("c_name").alias("gamertag"),
            F.when(F.col("c_acctbal") > 0, "verified").otherwise("pending").alias("status"),
        )

    @cached_property
    def case_variants(self) -> DataFrame:
        """The label links, and every third one again in capitals."""
        again = self.claims.where("id % 3 = 0").withColumns({
            "gamertag": F.upper("gamertag"), "status": F.when(F.col("id") % 6 == 0, "verified").otherwise(F.col("status"))})
        return self.claims.union(again)

    @cached_property
    def referrals(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            F.concat(F.lit("C"), c.cast("string")).alias("user_id"),
            F.concat(F.lit("C"), (c % 50).cast("string")).alias("referrer_user_id"),
        )

    @cached_property
    def prose(self) -> DataFrame:
        """Documents as articles, one kind per source."""
        marks = self.raw("labels").select("doc_id", "quality")
        return self.raw("documents").join(marks, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("source").alias("kind"),
            F.when(F.col("quality") == 1, "published").otherwise("failed").alias("status"),
            F.col("text").alias("headline"), F.col("text").alias("lede"), "text", "lang",
            F.col("source").alias("pull_quote_attribution"),
            F.timestamp_seconds(1_704_067_200 + F.col("doc_id") * 60).alias("created_at"),
        )

    @cached_property
    def dataset(self) -> Dataset:
        p = self.projections
        tables = {
            "servers": self.servers, "players": p.players, "player_gamertags": p.player_gamertags,
            "lives": p.lives, "sessions": p.sessions, "kills": p.kills, "hit_events": p.hit_events,
            "build_events": p.build_events, "positions": p.positions,
            "unconscious_events": p.unconscious_events, "gamertag_links": self.links,
            "avatars": self.avatars, "bans": self.bans, "articles": self.articles,
            "location_shares": self.shares, "notifications": self.notifications,
            "push_subscriptions": self.subscriptions, "syndications": self.syndications,
        }
        return Dataset(
            tables, NOW, qualify_seconds=QUALIFY, gap_seconds=GAP, recent_seconds=RECENT,
            fresh_seconds=FRESH,
        )


_WORLDS: dict[tuple[str, str], World] = {}


def world(spark: SparkSession, sf_dir: str) -> World:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _WORLDS:
        _WORLDS[key] = World(spark, sf_dir.rstrip("/"))
    return _WORLDS[key]
