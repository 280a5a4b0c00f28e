"""Log line extraction: one columnar pass from raw lines to typed events.

Every ``extract_*`` takes the line Column and returns a struct Column that is null when the line
is not of that kind.  All matching is JVM-side regular expressions, each behind a plain substring
test so that most lines never reach a pattern they cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_class
from ..operators.ordered import event_slice, ordered_scan, prev, running_sum, upto
from ..staging import stage

# The log format.
PLAYER = r'Player "([^"]+)"'
WITH_ID = r'Player "([^"]+)"\s*\(id=([^\s)]+)[^)]*\)'
DEAD = r'Player "([^"]+)" \(DEAD\) \(id=([^\s)]+)[^)]*\)'
HEADER = r"AdminLog started on (\d{4})-(\d{2})-(\d{2}) at (\d{2}):(\d{2}):(\d{2})"
ROSTER = r"#####\s*PlayerList log:\s*(\d+)\s*players"
CLOCK = r"^(\d{2}):(\d{2}):(\d{2})"
KILLED_BY_PLAYER = DEAD + r' killed by Player "([^"]+)" \(id=([^\s)]+)[^)]*\)(.*)$'
WEAPON = r"with (.+?)(?: from ([\d.]+) meters)?\s*$"
DEATH_VERB = r"\b(died|committed suicide|bled out|drowned|killed by)\b"
VITALS = r"Stats>\s*Water:\s*([\d.]+)\s*Energy:\s*([\d.]+)\s*Bleed sources:\s*(\d+)"
BUILD = (
    r'Player "([^"]+)"[^)]*\)\s*(placed|Built|Dismantled|packed|repaired)\s+(.+?)'
    r"(?:<([^>]+)>)?(?: with (.+?))?\s*$"
)
EMOTE = r'Player "([^"]+)"[^)]*\) performed (Emote[A-Za-z0-9]+)(?: with (.+?))?\s*$'
TELEPORT = (
    r'Player "([^"]+)"[^)]*\) was teleported from: <([^>]+)> to: <([^>]+)>\. Reason: (.+?)\s*$'
)
DEATH_TAIL = r'Player "([^"]+)" \(DEAD\) \(id=([^\s)]+)[^)]*\)(.*)$'
KILLER_ENTITY = r"killed by ([A-Za-z0-9_]+)"
HIT_BY_PLAYER = r'hit by Player "([^"]+)"'
HIT_BY_ENTITY = r"hit by ([A-Za-z0-9_]+)"
HIT_POINTS = r"\[HP:\s*([\d.]+)\]"
DAMAGE = r"for ([\d.]+) damage"
BODY_PART = r"into ([A-Za-z]+)(?:\(\d+\))?"
POSITION = r"pos=<\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+)\s*>"
OFF_MAP = r"(?i)pos=<\s*-?\d*\.?\d+e"
MAP_MIN, MAP_MAX = -1000.0, 16360.0
VEHICLES = r"^(CivilianSedan|Hatchback_|Sedan_|Offroad|Truck_|Boat_)"
ROLLOVER_SECONDS = 43_200
CLOCK_STEP_MS = 900_000


def _group(c: Column, pattern: str, index: int) -> Column:
    """Group of the first match; null when there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def _number(text: Column) -> Column:
    """Leading decimal number of a text, null when there is none."""
    return F.regexp_extract(text, r"^\s*(-?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def _decimal(text: Column) -> Column:
    """Number of a text of digits and dots; of several dots only the first counts."""
    return F.coalesce(text.try_cast("double"), _number(text))


def _when(condition: Column, **fields: Column) -> Column:
    return F.when(condition, F.struct(*[v.alias(k) for k, v in fields.items()]))


def extract_boot(c: Column) -> Column:
    parts = [F.regexp_extract(c, HEADER, i) for i in range(1, 7)]
    local = F.concat(
        F.concat_ws("-", *parts[:3]), F.lit(" "), F.concat_ws(":", *parts[3:])
    )
    return _when(c.contains("AdminLog started on ") & c.rlike(HEADER), localDateTime=local)


def extract_roster(c: Column) -> Column:
    return _when(c.contains("PlayerList log:") & c.rlike(ROSTER), count=_group(c, ROSTER, 1).cast("int"))


def extract_presence(c: Column, what: str) -> Column:
    """``what``: connecting, connected or disconnected."""
    suffix = {
        "connecting": " is connecting", "connected": " is connected",
        "disconnected": " has been disconnected",
    }[what]
    pattern = WITH_ID + suffix
    matched = c.contains(suffix) & c.rlike(pattern)
    if what == "connected":
        matched = matched & ~c.contains(" is connecting")
    return _when(matched, gamertag=_group(c, pattern, 1), dayzId=_group(c, pattern, 2))


def entity_cause(entity: Column) -> Column:
    """Death cause named by a killer entity class; null when the class is not known."""
    return F.coalesce(
        entity_class(entity),
        F.when(entity.startswith("Zmb"), "infected")
        .when(entity == "FallDamage", "fall")
        .when(entity.rlike(VEHICLES), "vehicle"),
    )


def extract_death(c: Column) -> Column:
    """PvP and other deaths.  A bare DEAD marker without a death verb is not a death."""
    is_pvp = c.contains("killed by Player") & c.rlike(KILLED_BY_PLAYER)
    rest = F.regexp_extract(c, KILLED_BY_PLAYER, 5)
    tail = F.regexp_extract(c, DEATH_TAIL, 3)
    low = F.lower(tail)
    entity = _group(tail, KILLER_ENTITY, 1)
    cause = (
        F.when(low.contains("bled out"), "bled_out")
        .when(low.contains("drowned"), "drowned")
        .when(low.contains("committed suicide"), "suicide")
        .when(low.contains("killed by"), F.coalesce(entity_cause(entity), F.lit("environment")))
        .otherwise("died")
    )

    def other(value: Column) -> Column:
        return F.when(~is_pvp, value)

    def pvp(value: Column) -> Column:
        return F.when(is_pvp, value)

    is_death = c.contains("(DEAD)") & ~c.contains("hit by") & c.rlike(DEAD) & (is_pvp | low.rlike(DEATH_VERB))
    return _when(
        is_death,
        victim=F.when(is_pvp, _group(c, KILLED_BY_PLAYER, 1)).otherwise(_group(c, DEAD, 1)),
        dayzId=F.when(is_pvp, _group(c, KILLED_BY_PLAYER, 2)).otherwise(_group(c, DEAD, 2)),
        cause=F.when(is_pvp, F.lit("pvp")).otherwise(cause),
        killer=pvp(_group(c, KILLED_BY_PLAYER, 3)),
        weapon=pvp(F.trim(_group(rest, WEAPON, 1))),
        distance=pvp(_decimal(_group(rest, WEAPON, 2))),
        energy=other(_decimal(_group(tail, VITALS, 2))),
        water=other(_decimal(_group(tail, VITALS, 1))),
        bleedSources=other(_group(tail, VITALS, 3).try_cast("int")),
        deathEntity=other(F.when(low.contains("killed by"), entity)),
    )


def coordinates(c: Column) -> Column:
    """Struct (x, y) of a line, null off the map or without a position.  Bound once."""
    pair = F.struct(_decimal(_group(c, POSITION, 1)).alias("x"), _decimal(_group(c, POSITION, 2)).alias("y"))
    inside = F.filter(
        F.array(pair), lambda p: p["x"].between(MAP_MIN, MAP_MAX) & p["y"].between(MAP_MIN, MAP_MAX)
    )
    return F.when(c.contains("pos=<") & ~c.rlike(OFF_MAP), F.get(inside, 0))


def extract_hit(c: Column, xy: Column | None = None) -> Column:
    xy = coordinates(c) if xy is None else xy
    kind = (
        F.when(c.rlike(HIT_BY_PLAYER), "player").when(c.contains("hit by Infected"), "infected")
        .otherwise("environment")
    )
    label = F.when(kind == "infected", "Infected").when(
        kind == "environment", _group(c, HIT_BY_ENTITY, 1)
    )
    return _when(
        c.contains("hit by") & c.rlike(PLAYER),
        victim=_group(c, PLAYER, 1),
        victimHp=_decimal(_group(c, HIT_POINTS, 1)),
        attackerType=kind,
        attackerGamertag=F.when(kind == "player", _group(c, HIT_BY_PLAYER, 1)),
        attackerLabel=label,
        damage=_decimal(_group(c, DAMAGE, 1)),
        bodyPart=_group(c, BODY_PART, 1),
        x=xy["x"], y=xy["y"],
    )


def extract_build(c: Column, xy: Column | None = None) -> Column:
    xy = coordinates(c) if xy is None else xy
    verbs = c.contains("placed") | c.contains("Built") | c.contains("Dismantled") | c.contains("packed")
    return _when(
        (verbs | c.contains("repaired")) & c.rlike(BUILD),
        gamertag=_group(c, BUILD, 1), action=F.lower(_group(c, BUILD, 2)),
        object=F.trim(_group(c, BUILD, 3)), className=_group(c, BUILD, 4),
        tool=F.trim(_group(c, BUILD, 5)), x=xy["x"], y=xy["y"],
    )


def extract_emote(c: Column, xy: Column | None = None) -> Column:
    xy = coordinates(c) if xy is None else xy
    return _when(
        c.contains(" performed Emote") & c.rlike(EMOTE), gamertag=_group(c, EMOTE, 1), emote=_group(c, EMOTE, 2),
        item=F.trim(_group(c, EMOTE, 3)), x=xy["x"], y=xy["y"],
    )


def extract_teleport(c: Column) -> Column:
    def triple(index: int) -> Column:
        parts = F.split(_group(c, TELEPORT, index), ",")
        return F.transform(F.slice(parts, 1, 3), lambda p: _number(p))

    return _when(
        c.contains(" was teleported from: ") & c.rlike(TELEPORT), **{
            "gamertag": _group(c, TELEPORT, 1), "from": triple(2), "to": triple(3),
            "reason": _group(c, TELEPORT, 4),
        }
    )


def extract_position(c: Column, xy: Column | None = None) -> Column:
    xy = coordinates(c) if xy is None else xy
    return _when(
        xy.isNotNull() & ~c.contains("hit by") & c.rlike(PLAYER),
        gamertag=_group(c, PLAYER, 1), x=xy["x"], y=xy["y"],
    )


def extract_unconscious(c: Column, xy: Column | None = None) -> Column:
    leaving = c.contains("is disconnecting while being unconscious")
    xy = coordinates(c) if xy is None else xy
    return _when(
        ~c.contains("(DEAD)") & (leaving | c.contains("is unconscious")) & c.rlike(PLAYER),
        gamertag=_group(c, PLAYER, 1), disconnecting=leaving, x=xy["x"], y=xy["y"],
    )


# Line kind to event type, in the order a line emits its events.  Knockouts come
# after positions so that the sub_index of stored position events stays what it was.
_KINDS = [
    ("player.connecting", lambda c, xy: extract_presence(c, "connecting")),
    ("player.connected", lambda c, xy: extract_presence(c, "connected")),
    ("player.disconnected", lambda c, xy: extract_presence(c, "disconnected")),
    ("player.died", lambda c, xy: extract_death(c)),
    ("emote.performed", extract_emote),
    ("player.hit", extract_hit),
    ("build", extract_build),
    ("player.teleported", lambda c, xy: extract_teleport(c)),
    ("player.position", extract_position),
    ("player.unconscious", extract_unconscious),
]


def _event(event_type: str, payload: Column) -> Column:
    kind = F.lit(event_type)
    if event_type == "build":
        kind = F.concat(F.lit("build."), payload["action"])
    body = F.to_json(payload, {"ignoreNullFields": "false"})
    return F.when(payload.isNotNull(), F.struct(kind.alias("type"), body.alias("payload")))


def parse_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines -> events (``sub_index``, ``type``, JSON ``payload``); other columns are kept.

    Header and roster lines yield exactly their one event.
    """
    c = F.col(text)
    kept = [k for k in lines.columns if k != text]
    # Coordinates, then line structs, then events: each projection uses the columns of the one
    # before several times, so Spark keeps them apart and computes every struct once.
    lines = lines.withColumn("__xy", coordinates(c))
    found = {"__boot": extract_boot(c), "__roster": extract_roster(c)}
    found |= {f"__k{i}": extract(c, F.col("__xy")) for i, (_, extract) in enumerate(_KINDS)}
    lines = lines.withColumns(found)
    boot = _event("server.rebooted", F.col("__boot"))
    roster = _event("roster.snapshot", F.col("__roster"))
    many = F.array_compact(F.array(*[_event(t, F.col(f"__k{i}")) for i, (t, _) in enumerate(_KINDS)]))
    events = (
        F.when(F.col("__boot").isNotNull(), F.array(boot))
        .when(F.col("__roster").isNotNull(), F.array(roster))
        .otherwise(many)
    )
    return lines.select(*kept, F.posexplode(events).alias("sub_index", "__e")).select(
        *kept, "sub_index", "__e.type", "__e.payload"
    )


def assign_timestamps(
    lines: DataFrame, fallback: str = "started_at", offset_ms: str | None = None
) -> DataFrame:
    """Add ``occurred_at`` to numbered lines (file, line_index, text).

    A header sets the date; a clock that falls by more than 12 h against the line before starts
    the next day; files without a header use the date of column ``fallback``.  Header and
    undated lines get null.  ``offset_ms`` names a column added to every instant.
    """
    c = F.col("text")
    header = c.rlike(HEADER)

    def clock(pattern: str, first: int) -> Column:
        h, m, s = [F.regexp_extract(c, pattern, first + i).try_cast("int") for i in range(3)]
        return h * 3600 + m * 60 + s

    marked = lines.select(
        "file", "line_index", F.col(fallback).cast("date").alias("fallback_date"),
        *( [F.col(offset_ms).alias("offset_ms")] if offset_ms else [F.lit(0).cast("long").alias("offset_ms")] ),
        F.when(header, F.concat_ws("-", *[F.regexp_extract(c, HEADER, i) for i in (1, 2, 3)]))
        .try_cast("date").alias("header_date"),
        F.when(header, clock(HEADER, 4)).when(c.rlike(CLOCK), clock(CLOCK, 1)).alias("sec"),
    ).where(F.col("sec").isNotNull())
    keys, order = ["file"], ["line_index"]
    timed = ordered_scan(marked, keys, order, event_slice("line_index"), before=prev(F.col("sec")))
    rolls = F.when(
        F.col("header_date").isNull() & (F.col("before") - F.col("sec") > ROLLOVER_SECONDS), 1
    ).otherwise(0)
    timed = ordered_scan(
        timed, keys, order, event_slice("line_index"), days=running_sum(rolls)
    )
    timed = ordered_scan(
        stage(timed, "line-clock"), keys, order, event_slice("line_index"),
        base=upto(F.when(F.col("header_date").isNotNull(), F.struct("header_date", "days"))),
    )
    day = F.date_add(
        F.coalesce("base.header_date", "fallback_date"),
        (F.col("days") - F.coalesce("base.days", F.lit(0))).cast("int"),
    )
    instant = F.timestamp_millis(
        F.unix_millis(day.cast("timestamp")) + F.col("sec") * 1000 + F.col("offset_ms")
    )
    stamped = timed.where(F.col("header_date").isNull()).select(
        "file", "line_index", instant.alias("occurred_at")
    )
    return lines.join(stamped, ["file", "line_index"], "left")


def events_from_lines(
    lines: DataFrame, fallback: str = "started_at", offset_ms: str | None = None
) -> DataFrame:
    """Numbered lines -> events; events without an instant take the file start plus offset."""
    stamped = assign_timestamps(lines, fallback, offset_ms)
    offset = F.col(offset_ms) if offset_ms else F.lit(0)
    start = F.timestamp_millis(F.unix_millis(F.col(fallback).cast("timestamp")) + offset)
    return parse_lines(stamped).withColumn("occurred_at", F.coalesce("occurred_at", start))
