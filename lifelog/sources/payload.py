"""Typed view of the event log and the valid / quarantine split of its JSON payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BUILD_TYPES, PAYLOAD

_COLUMNS = {
    "gamertag": "gamertag", "dayzId": "dayz_id", "victim": "victim", "cause": "cause",
    "killer": "killer", "weapon": "weapon", "distance": "distance", "energy": "energy",
    "water": "water", "bleedSources": "bleed_sources", "deathEntity": "death_entity",
    "victimHp": "victim_hp", "attackerType": "attacker_type",
    "attackerGamertag": "attacker_gamertag", "attackerLabel": "attacker_label",
    "damage": "damage", "bodyPart": "body_part", "x": "x", "y": "y",
    "disconnecting": "disconnecting", "action": "action", "object": "object",
    "className": "class_name", "tool": "tool", "emote": "emote", "item": "item",
    "count": "roster_count", "localDateTime": "local_date_time",
}

# Payload fields each event type must carry with a value.
REQUIRED = {
    "player.connecting": ["gamertag"],
    "player.connected": ["gamertag"],
    "player.disconnected": ["gamertag"],
    "player.died": ["victim", "cause"],
    "player.hit": ["victim", "attackerType"],
    "player.position": ["gamertag", "x", "y"],
    "server.rebooted": ["localDateTime"],
    **{t: ["gamertag", "action", "object"] for t in BUILD_TYPES},
}
# Fields that must be present but may be null.
PRESENT = {"player.died": ["killer", "weapon", "distance"]}


def typed_events(events: DataFrame) -> DataFrame:
    """Parse each JSON payload once into flat, typed columns."""
    parsed = events.withColumn("__p", F.from_json("payload", PAYLOAD))
    fixed = [c for c in events.columns if c != "payload"]
    return parsed.select(
        *fixed, *[F.col(f"__p.{field}").alias(name) for field, name in _COLUMNS.items()]
    )


def _valid() -> Column:
    """Whether type and payload agree.  The parsed payload is bound once and tested many times."""
    parsed = F.struct(
        F.from_json("payload", PAYLOAD).alias("body"), F.json_object_keys("payload").alias("keys")
    )

    def rule(p: Column) -> Column:
        ok = F.lit(True)
        for event_type, fields in REQUIRED.items():
            held = reduce(Column.__and__, [p["body"][f].isNotNull() for f in fields])
            for field in PRESENT.get(event_type, []):
                held = held & F.array_contains(p["keys"], field)
            ok = F.when(F.col("type") == event_type, held).otherwise(ok)
        return p["keys"].isNotNull() & p["body"].isNotNull() & ok

    return F.coalesce(F.exists(F.array(parsed), rule), F.lit(False))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): a bad payload is set aside and never fails the batch."""
    ok = _valid()
    return events.where(ok), events.where(~ok)
