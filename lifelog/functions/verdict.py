"""Death verdict: a ladder over per-life evidence that is already aggregated to one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stated mechanisms and thresholds of the ladder.
NAMED_MECHANISMS = ["wolf", "bear", "animal", "infected", "fall", "vehicle", "explosion"]
STARVED_MAX = 1
PARCHED_MAX = 1
TERMINAL_HP_MAX = 1


def classify_death(
    mechanism: Column,
    energy: Column,
    water: Column,
    bleed_sources: Column,
    recent_hits: Column,
    recent_infected_hits: Column,
    infected_hp_low: Column,
    fatal_falls: Column,
    knockouts: Column,
) -> Column:
    """Struct (cause, confidence, conditions).

    A stated mechanism explains its own side effects and always wins.  Only a bare or missing
    mechanism is inferred: fatal fall, starvation, dehydration, mauled by infected, bled out.
    The evidence columns count hits and knockouts in the recent window before the death.
    """
    starving = F.coalesce(energy <= STARVED_MAX, F.lit(False))
    parched = F.coalesce(water <= PARCHED_MAX, F.lit(False))
    hunted = recent_infected_hits > 0
    bleeding = F.coalesce(bleed_sources > 0, F.lit(False))
    terminal = F.coalesce(infected_hp_low <= TERMINAL_HP_MAX, F.lit(False))
    mauled = hunted & (bleeding | (knockouts > 0) | terminal)
    bled_out = bleeding & (recent_hits > 0)

    stated = F.coalesce(mechanism, F.lit("")).isin(
        "pvp", "suicide", "bled_out", "drowned", "environment", *NAMED_MECHANISMS
    )
    cause = (
        F.when(mechanism.isin("drowned", "environment"), "environmental")
        .when(stated, mechanism)
        .when(fatal_falls > 0, "fall")
        .when(starving, "starvation")
        .when(parched, "dehydration")
        .when(mauled, "mauled")
        .when(bled_out, "bled_out")
        .otherwise("unknown")
    )
    certain = stated | (fatal_falls > 0)
    confidence = (
        F.when(certain, "high")
        .when(starving | parched, F.when(recent_hits > 0, "low").otherwise("high"))
        .when(mauled | bled_out, "high")
        .otherwise("low")
    )
    base = F.filter(
        F.array(
            F.when(starving, "starving"), F.when(parched, "dehydrated"), F.when(hunted, "hunted")
        ),
        lambda c: c.isNotNull(),
    )
    or_healthy = F.when(F.size(base) > 0, base).otherwise(F.array(F.lit("healthy")))
    inferred_bleed = ~certain & ~starving & ~parched & bleeding & (mauled | bled_out)
    conditions = (
        F.when((mechanism == "bled_out") | inferred_bleed, F.array_append(base, F.lit("bleeding")))
        .when(mechanism == "drowned", F.array_append(base, F.lit("drowned")))
        .otherwise(or_healthy)
    )
    return F.struct(
        cause.alias("cause"), confidence.alias("confidence"), conditions.alias("conditions")
    )
