"""Backfills over stored raw lines.  Each returns the rows to append or replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import extract_death, extract_unconscious
from .tables import EVENT_KEY, append_new

# Causes a better reading of the line may replace.
UPGRADEABLE = ["environment", "died", "unknown"]

_DEATH = (
    "victim string, dayzId string, cause string, killer string, weapon string, distance double, "
    "energy double, water double, bleedSources int, deathEntity string"
)


def backfill_unconscious(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Knockout events of old raw lines (sub_index 1), minus those already stored.

    ``raw(raw_line_id, server_id, file_id, line_index, occurred_at, text)``.
    """
    lines = raw.where(F.col("text").contains("unconscious") & F.col("occurred_at").isNotNull())
    found = lines.withColumn("__u", extract_unconscious(F.col("text"))).where(F.col("__u").isNotNull())
    rows = found.select(
        "server_id", "file_id", "line_index", F.lit(1).alias("sub_index"),
        F.lit("player.unconscious").alias("type"), "occurred_at",
        F.to_json("__u", {"ignoreNullFields": "false"}).alias("payload"), "raw_line_id",
    )
    return append_new(rows, events, EVENT_KEY)


def _deaths_with_lines(events: DataFrame, raw: DataFrame) -> DataFrame:
    lines = raw.where(F.col("text").contains("(DEAD)")).select(
        "raw_line_id", extract_death(F.col("text")).alias("__d")
    ).where(F.col("__d").isNotNull())
    deaths = events.where((F.col("type") == "player.died") & F.col("raw_line_id").isNotNull())
    return deaths.withColumn("__p", F.from_json("payload", _DEATH)).join(lines, "raw_line_id")


def _with_payload(rows: DataFrame, columns: list[str], **changes) -> DataFrame:
    body = F.col("__p")
    for field, value in changes.items():
        body = body.withField(field, value)
    return rows.withColumn("payload", F.to_json(body, {"ignoreNullFields": "false"})).select(*columns)


def rederive_causes(events: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched events, survey of unmapped entities).

    A vague stored cause takes the named cause of the line; a missing killer entity is filled.
    """
    rows = _deaths_with_lines(events, raw)
    old, new = F.col("__p.cause"), F.col("__d.cause")
    survey = rows.where(F.col("__d.deathEntity").isNotNull() & (new == "environment")).groupBy(
        F.col("__d.deathEntity").alias("entity")
    ).agg(F.count("*").alias("deaths"))
    upgrade = F.coalesce(old.isin(UPGRADEABLE) & ~new.isin(UPGRADEABLE), F.lit(False))
    fill = F.col("__d.deathEntity").isNotNull() & F.col("__p.deathEntity").isNull()
    patched = _with_payload(
        rows.where(upgrade | fill), events.columns,
        cause=F.when(upgrade, new).otherwise(old),
        deathEntity=F.when(fill, F.col("__d.deathEntity")).otherwise(F.col("__p.deathEntity")),
    )
    return patched, survey


def rederive_vitals(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Death events without any vitals, filled from their line; a bare 'died' also takes the
    cause of the line."""
    rows = _deaths_with_lines(events, raw)
    vitals = ["energy", "water", "bleedSources"]
    absent = F.coalesce(*[F.col(f"__p.{v}").cast("double") for v in vitals]).isNull()
    present = F.coalesce(*[F.col(f"__d.{v}").cast("double") for v in vitals]).isNotNull()
    old, new = F.col("__p.cause"), F.col("__d.cause")
    return _with_payload(
        rows.where(absent & present), events.columns,
        cause=F.when((old == "died") & (new != "died"), new).otherwise(old),
        **{v: F.col(f"__d.{v}") for v in vitals},
    )
