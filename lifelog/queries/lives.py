"""Life records: dossier, verdict, timeline, track and obituary facts, for all lives at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import FRESH_SPAWN_SECONDS, LEGEND_KILLS, LEGEND_SECONDS
from ..functions.scalars import (
    board_duration,
    elapsed_label,
    encounter_line,
    encounter_title,
    is_unrecorded_cause,
    round_half_up,
    seconds_between,
    time_alive_label,
    vitals_line,
)
from ..functions.verdict import classify_death
from ..operators.aggregates import life_ordeals
from ..operators.joins import LIFE_KEYS, asof_fix, in_lives
from ..operators.ordered import latest_by
from ..operators.windows import life_encounters, played_seconds_at, segment_track, session_groups
from ..staging import stage
from .dataset import Dataset


def dossier_hits(d: Dataset) -> DataFrame:
    """Hits of the dossier window; an open life has a zero-width one."""
    ends = d["lives"].select(
        F.col("id").alias("life_id"), F.coalesce("ended_at", "started_at").alias("window_end")
    )
    return d.life_hits.join(ends, "life_id").where(F.col("occurred_at") <= F.col("window_end"))


def _before_end(at: str, end: str):
    return round_half_up((F.unix_millis(end) - F.unix_millis(at)) / 1000)


def life_dossier(d: Dataset) -> DataFrame:
    """Per life: ordeals, lowest hit points, recent evidence counts and death vitals."""
    hits = dossier_hits(d)
    ordeals = life_ordeals(d["lives"], hits, d["build_events"], d["sessions"], d.gap_seconds)
    age = _before_end("occurred_at", "window_end")
    recent = hits.where((age >= 0) & (age <= d.recent_seconds))
    infected = F.col("attacker_type") == "infected"
    fall = F.col("attacker_label").startswith("FallDamage") & (F.col("victim_hp") <= 0)
    evidence = recent.groupBy("life_id").agg(
        F.count("*").alias("recent_hits"),
        F.count_if(infected).alias("recent_infected_hits"),
        F.min(F.when(infected, F.col("victim_hp"))).alias("infected_hp_low"),
        F.count_if(F.coalesce(fall, F.lit(False))).alias("fatal_falls"),
    )
    ends = d["lives"].select(
        F.col("id").alias("life_id"), F.coalesce("ended_at", "started_at").alias("window_end")
    )
    down_age = _before_end("occurred_at", "window_end")
    down = (
        d.life_knockouts.join(ends, "life_id")
        .where((down_age >= 0) & (down_age <= d.recent_seconds))
        .groupBy("life_id").agg(F.count("*").alias("recent_knockouts"))
    )
    facts = d["lives"].select(
        F.col("id").alias("life_id"), *LIFE_KEYS, "life_number", "started_at", "ended_at",
        "playtime_seconds", "death_cause", "death_weapon", "energy_at_death", "water_at_death",
        "bleed_sources_at_death",
    )
    return (
        facts.join(ordeals, "life_id")
        .join(evidence, "life_id", "left")
        .join(down, "life_id", "left")
        .fillna(0, ["recent_hits", "recent_infected_hits", "fatal_falls", "recent_knockouts"])
    )


def death_verdicts(d: Dataset) -> DataFrame:
    """Dossier with the struct ``verdict`` (cause, confidence, conditions) of ended lives."""
    verdict = classify_death(
        F.col("death_cause"), F.col("energy_at_death"), F.col("water_at_death"),
        F.col("bleed_sources_at_death"), F.col("recent_hits"), F.col("recent_infected_hits"),
        F.col("infected_hp_low"), F.col("fatal_falls"), F.col("recent_knockouts"),
    )
    return life_dossier(d).withColumn("verdict", F.when(F.col("ended_at").isNotNull(), verdict))


def encounters_of(d: Dataset) -> DataFrame:
    ended = d["lives"].select(F.col("id").alias("life_id"), "ended_at")
    return life_encounters(d.life_hits, ended, d.gap_seconds, d.recent_seconds)


def life_timeline(d: Dataset) -> DataFrame:
    """One record per life; verdict and ordeals only once it has ended."""
    status = d.life_status.select(
        F.col("id").alias("life_id"), "gamertag", "kills", "longest_kill_meters", "last_seen_at"
    )
    spans = d.encounters.groupBy("life_id").agg(F.count("*").alias("encounter_count"))
    published = d["articles"].where(
        (F.col("kind") == "obituary") & (F.col("status") == "published")
    ).select(
        F.lower("gamertag").alias("label"), "server_id",
        F.col("life_started_at").alias("started_at"), "slug",
    )
    held = d["player_gamertags"].select("player_id", F.lower("gamertag").alias("label")).distinct()
    filed = published.join(held, "label").groupBy(*LIFE_KEYS, "started_at").agg(
        F.min("slug").alias("obituary_slug")
    )
    ended = F.col("ended_at").isNotNull()
    ordeal = [f"{o}_{c}" for o in ("fire", "infected", "pvp") for c in ("encounters", "hits", "worst")]
    rows = d.verdicts
    for column in [*ordeal, "hp_low"]:
        rows = rows.withColumn(column, F.when(ended, F.col(column)))
    return (
        rows.join(status, "life_id")
        .join(d.qualified_at, "life_id", "left")
        .join(spans, "life_id", "left")
        .join(filed, [*LIFE_KEYS, "started_at"], "left")
        .fillna(0, ["encounter_count"])
    )


def timeline_events(d: Dataset) -> DataFrame:
    """All timeline rows of all lives: (life_id, kind, at, time_label, title, line, name, and for
    kills and deaths distance, weapon and verdict).

    Rows carry ``at``; order by it descending to display.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def shape(
        df: DataFrame, kind, title=text, line=text, label=text, name=text, distance=number, weapon=text, verdict=text
    ) -> DataFrame:
        return df.select(
            "life_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "at",
            title.alias("title"), line.alias("line"), label.alias("fixed_label"), name.alias("name"),
            distance.alias("distance"), weapon.alias("weapon"), verdict.alias("verdict"),
        )

    lives = d.life_status.select(
        F.col("id").alias("life_id"), "started_at", "ended_at", "playtime_seconds", "player_id",
        "death_cause", "death_by_gamertag", "death_weapon", "death_distance", "energy_at_death",
        "water_at_death", "bleed_sources_at_death",
    )
    birth = shape(
        lives.withColumn("at", F.col("started_at")), "birth",
        F.lit("Washed ashore — life begins"), F.lit("Session 1. Grace period active."), F.lit("0h 00m"),
    )
    why = (
        F.when(F.col("qualified_by") == "kill", "First blood drawn. The life counts from here.")
        .when(F.col("qualified_by") == "pvp-death",
              "Qualified at the moment of death — killed by a player.")
        .otherwise("Five minutes survived. The grace period ends; from here, death counts.")
    )
    qualified = shape(
        d.qualified_at.withColumn("at", F.col("qualified_at")), "qualified", F.lit("Life qualified"), why
    )
    runs = session_groups(d["sessions"], d.life_kills, d.now)
    single = F.col("kind") == "session"
    logins = shape(
        runs, F.col("kind"),
        F.when(single, F.concat(F.lit("Session "), F.col("first").cast("string"), F.lit(" began")))
        .otherwise(F.concat(F.lit("Sessions "), F.col("first").cast("string"), F.lit("–"),
                            F.col("last").cast("string"))),
        F.when(single, "Logged in.").otherwise(
            F.concat((F.col("last") - F.col("first") + 1).cast("string"), F.lit(" logins"))
        ),
    )
    longest = (
        d.life_kills.where(F.col("distance").isNotNull()).groupBy("life_id").agg(
            F.max_by(
                "victim_life_id", F.struct("distance", -F.unix_micros("occurred_at"), -F.col("victim_life_id"))
            ).alias("longest_victim")
        )
    )
    kills = d.life_kills.join(longest, "life_id", "left").withColumn("at", F.col("occurred_at"))
    kills = shape(
        kills, "kill", F.col("weapon"),
        F.when(F.col("victim_life_id") == F.col("longest_victim"), "longest kill"),
        name=F.col("victim_gamertag"), distance=F.col("distance"), weapon=F.col("weapon"),
    )
    fights = d.encounters.withColumn("at", F.col("started_at"))
    args = [F.col("category"), F.col("hits"), F.col("duration_seconds")]
    fights = shape(
        fights, "encounter", encounter_title(*args), encounter_line(*args, F.col("hp_low")),
        name=F.col("attacker_gamertag"),
    )
    played = d["sessions"].join(d.last_seen, "player_id", "left")
    share = F.when(
        F.col("disconnected_at").isNotNull(),
        F.coalesce("duration_seconds", seconds_between(F.col("connected_at"), F.col("disconnected_at"))),
    ).otherwise(
        seconds_between(F.col("connected_at"), F.coalesce("last_seen_at", "connected_at"))
    )
    alive_for = played.groupBy("life_id").agg(F.sum(share).alias("alive_seconds"))
    here = shape(
        lives.where(F.col("ended_at").isNull()).join(alive_for, "life_id").withColumn("at", d.now),
        "now", F.lit("Still drawing breath"), board_duration(F.col("alive_seconds")), F.lit("NOW"),
    )
    causes = d.verdicts.select("life_id", F.col("verdict.cause").alias("verdict_cause"))
    deaths = shape(
        lives.where(F.col("ended_at").isNotNull()).join(causes, "life_id", "left").withColumn("at", F.col("ended_at")), "death",
        F.col("death_cause"),
        vitals_line(F.col("energy_at_death"), F.col("water_at_death"), F.col("bleed_sources_at_death")),
        F.concat(elapsed_label(F.col("playtime_seconds")), F.lit(" in")),
        F.col("death_by_gamertag"), F.col("death_distance"), F.col("death_weapon"), F.col("verdict_cause"),
    )
    moving = qualified.unionByName(logins).unionByName(kills).unionByName(fights)
    clocked = played_seconds_at(moving, d["sessions"], d.last_seen)
    clocked = clocked.withColumn(
        "fixed_label", F.concat(elapsed_label(F.col("played_seconds")), F.lit(" in"))
    ).drop("played_seconds")
    return (
        clocked.unionByName(birth).unionByName(here).unionByName(deaths)
        .withColumnRenamed("fixed_label", "time_label")
    )


def life_fixes(d: Dataset) -> DataFrame:
    """Position fixes inside each life; an open life reaches to the heartbeat."""
    windowed = d.lives_of.withColumn(
        "until", F.coalesce("ended_at", "last_seen_at", "started_at")
    )
    fixes = d["positions"].select(*LIFE_KEYS, "event_id", "x", "y", "recorded_at")
    return in_lives(fixes, windowed, "recorded_at", "until")


def life_track(d: Dataset) -> dict[str, DataFrame]:
    """Track of every life.

    ``points``: thinned trail split by session; ``markers``: kills, death or current place at the
    last raw fix before them; ``summary``: number of fixes and of those kept in the trail.
    """
    raw, thinned = d.life_fixes, d.thinned_fixes
    caps = d.lives_of.select(
        F.col("id").alias("life_id"),
        F.coalesce("ended_at", "last_seen_at", "started_at").alias("cap_at"),
    )
    points = segment_track(
        thinned.select("life_id", "event_id", "x", "y", "recorded_at"), d["sessions"], caps
    )
    scored = d.life_kills.select(
        "life_id", *LIFE_KEYS, F.lit("kill").alias("kind"), F.col("occurred_at").alias("at"),
        F.col("victim_gamertag").alias("label"),
    ).join(caps, "life_id").where(F.col("at") <= F.col("cap_at")).drop("cap_at")
    none = F.lit(None).cast("string").alias("label")
    deaths = d["lives"].where(F.col("ended_at").isNotNull()).select(
        F.col("id").alias("life_id"), *LIFE_KEYS, F.lit("death").alias("kind"),
        F.col("ended_at").alias("at"), none,
    )
    newest = latest_by(
        raw.select("life_id", *LIFE_KEYS, "recorded_at", "event_id"), ["life_id"],
        [F.col("recorded_at"), F.col("event_id")],
    )
    alive = d["lives"].where(F.col("ended_at").isNull()).select(F.col("id").alias("life_id"))
    here = newest.join(alive, "life_id", "left_semi").select(
        "life_id", *LIFE_KEYS, F.lit("now").alias("kind"), F.col("recorded_at").alias("at"), none
    )
    events = scored.unionByName(deaths).unionByName(here)
    # A fix counts for a marker only when it lies inside the marked life.
    starts = d["lives"].select(F.col("id").alias("life_id"), "started_at")
    markers = asof_fix(events, d["positions"], "at", d.fresh_seconds)
    markers = markers.join(starts, "life_id").where(F.col("sample_at") >= F.col("started_at"))
    summary = raw.groupBy("life_id").agg(F.count("*").alias("sample_count")).join(
        thinned.groupBy("life_id").agg(F.count("*").alias("kept")), "life_id"
    )
    return {
        "points": points,
        "markers": markers.select(
            "life_id", "kind", "at", "x", "y", "sample_at", "sample_age_seconds", "label"
        ),
        "summary": summary,
    }


def obituary_facts(d: Dataset) -> DataFrame:
    """Facts sheet of every ended life, with the player's reputation before it."""
    places = d["servers"].select(F.col("id").alias("server_id"), "map", F.col("slug").alias("map_slug"))
    lives = d.life_status.where(F.col("ended_at").isNotNull()).select(
        F.col("id").alias("life_id"), *LIFE_KEYS, "gamertag", "life_number", "ended_at",
        F.col("playtime_seconds").alias("time_alive_seconds"), "kills", "longest_kill_meters",
        F.col("death_cause").alias("cause"), F.col("death_by_gamertag").alias("killer_gamertag"),
        F.col("death_weapon").alias("weapon"), "death_distance",
    )
    verdicts = d.verdicts.select(
        "life_id", F.col("verdict.cause").alias("verdict_cause"),
        F.col("verdict.confidence").alias("verdict_confidence"), F.col("session_count").alias("sessions"),
        "hp_low", "fire_encounters", "infected_encounters", "pvp_encounters",
    )
    rows = (
        lives.join(places, "server_id")
        .join(verdicts, "life_id")
        .join(d.priors.drop("player_id"), "life_id")
    )
    named = ~is_unrecorded_cause(F.col("cause")) | ~is_unrecorded_cause(F.col("verdict_cause"))
    category = (
        F.when((F.col("cause") == "pvp") | (F.coalesce("killer_gamertag", F.lit("")) != ""), "pvp")
        .when(F.col("cause") == "suicide", "suicide")
        .when(named, "environment")
        .otherwise("unknown")
    )
    rows = rows.withColumn("cause_category", category)
    return (
        rows.withColumn("time_alive_label", time_alive_label(F.col("time_alive_seconds")))
        .withColumn(
            "is_legend",
            (F.col("kills") >= LEGEND_KILLS) | (F.col("time_alive_seconds") >= LEGEND_SECONDS),
        )
        .withColumn(
            "fresh_spawn_victim",
            (F.col("cause_category") == "pvp") & (F.col("time_alive_seconds") < FRESH_SPAWN_SECONDS),
        )
        .withColumn("is_known_quantity", F.col("lives_lived") > 0)
    )


__all__ = [
    "death_verdicts", "dossier_hits", "encounters_of", "life_dossier", "life_fixes",
    "life_timeline", "life_track", "obituary_facts", "timeline_events",
]
