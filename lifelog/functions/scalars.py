"""Scalar functions.  Every function takes Columns and returns a Column; none uses Python UDFs."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EMOTES, MAP_LABELS, MAP_WORLD_SIZE, MELEE_WEAPONS, PLACE_MIN_ZOOM


def _lookup(key: Column, values: dict) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def instant(at: datetime) -> Column:
    """Timestamp literal of a naive datetime in the session time zone, whatever the local one."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def round_half_up(value: Column) -> Column:
    """Rounding of halves towards +infinity: floor(x + 0.5)."""
    return F.floor(value + F.lit(0.5))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(end) - F.unix_millis(start)) / 1000))


def live_playtime(stored: Column, connected_at: Column, up_to: Column) -> Column:
    """Stored seconds plus the open session up to the heartbeat; unchanged when either is null."""
    return stored + F.coalesce(seconds_between(connected_at, up_to), F.lit(0).cast("long"))


def initcap_words(text: Column) -> Column:
    """Upper-case the first character of every word, leaving the others as they are."""
    # A word starts where a word character follows a non-word character.
    pieces = F.split(text, r"(?<=\W)(?=\w)")
    capped = F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    )
    return F.array_join(capped, "")


# --- slugs -------------------------------------------------------------------------------


def slug(text: Column) -> Column:
    """Lower-case, runs of other characters become one dash, outer dashes are dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def obituary_slug(headline: Column, gamertag: Column, server_id: Column, life_number: Column) -> Column:
    head = F.regexp_replace(F.substring(slug(headline), 1, 60), "-+$", "")
    head = F.when(head == "", "obituary").otherwise(head)
    name = F.when(slug(gamertag) == "", "survivor").otherwise(slug(gamertag))
    return F.concat_ws("-", head, name, server_id.cast("string"), life_number.cast("string"))


# --- durations, distances, dates ---------------------------------------------------------


def _hms(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = F.greatest(F.lit(0).cast("long"), F.floor(seconds))
    return s, F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60)


def _unit(value: Column, suffix: str) -> Column:
    return F.concat(value.cast("string"), F.lit(suffix))


def time_alive_label(seconds: Column) -> Column:
    """``2d 3h``, ``2d``, ``5h 0m`` or ``12m``."""
    s, d, h, m = _hms(seconds)
    hours = F.floor(s / 3600)
    return (
        F.when((d >= 1) & (h > 0), F.concat_ws(" ", _unit(d, "d"), _unit(h, "h")))
        .when(d >= 1, _unit(d, "d"))
        .when(hours > 0, F.concat_ws(" ", _unit(hours, "h"), _unit(m, "m")))
        .otherwise(_unit(m, "m"))
    )


def board_duration(seconds: Column) -> Column:
    """Non-zero parts of ``1d 2h 3m``; plain seconds below a minute."""
    s, d, h, m = _hms(seconds)
    parts = F.concat_ws(
        " ",
        F.when(d > 0, _unit(d, "d")), F.when(h > 0, _unit(h, "h")), F.when(m > 0, _unit(m, "m")),
    )
    return F.when(parts == "", _unit(s % 60, "s")).otherwise(parts)


def page_duration(seconds: Column) -> Column:
    """``5h 7m`` with hours unbounded."""
    s, _, _, m = _hms(seconds)
    return F.concat_ws(" ", _unit(F.floor(s / 3600), "h"), _unit(m, "m"))


def elapsed_label(seconds: Column) -> Column:
    """``0h 07m``."""
    s, _, _, m = _hms(seconds)
    return F.concat_ws(" ", _unit(F.floor(s / 3600), "h"), F.format_string("%02dm", m))


def distance_label(meters: Column) -> Column:
    return (
        F.when(meters.isNull(), "—")
        .when(meters >= 1000, F.format_string("%.2f km", meters / 1000))
        .otherwise(_unit(round_half_up(meters), " m"))
    )


def board_value_label(board: Column, value: Column) -> Column:
    """Seconds, metres or a plain count, by board."""
    return (
        F.when(board.isin("alive-longest", "alltime-longest"), board_duration(value))
        .when(board == "longest-kills", distance_label(value))
        .otherwise(value.cast("long").cast("string"))
    )


def relative_date(at: Column, now: Column) -> Column:
    days = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000)
    weeks, months = F.floor(days / 7), F.floor(days / 30)

    def ago(n: Column, unit: str) -> Column:
        plural = F.when(n > 1, f" {unit}s ago").otherwise(f" {unit} ago")
        return F.concat(n.cast("string"), plural)

    return (
        F.when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, ago(weeks, "week"))
        .otherwise(ago(months, "month"))
    )


def month_year(at: Column) -> Column:
    return F.date_format(at, "MMM yyyy")


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def ms_to_next_even_hour(at: Column) -> Column:
    return F.lit(7_200_000) - F.unix_millis(at) % 7_200_000


# --- causes ------------------------------------------------------------------------------


def cause_family(cause: Column) -> Column:
    return F.when(cause.isin("wolf", "bear", "animal"), "animal").otherwise(cause)


def cause_label(cause: Column) -> Column:
    return (
        F.when(cause == "pvp", "Killed")
        .when(cause == "fall", "Fell")
        .when(cause.isNull() | (cause == "") | (cause == "died"), "Unknown")
        .otherwise(initcap_words(F.replace(cause, F.lit("_"), F.lit(" "))))
    )


def verdict_phrase(verdict: Column, confidence: Column, conditions: Column, cause: Column) -> Column:
    """Display phrase of a verdict; ``verdict`` null means unclassified."""
    nouns = _lookup(
        verdict,
        {"suicide": "Suicide", "starvation": "Starvation", "dehydration": "Dehydration",
         "bled_out": "Bled out", "mauled": "Mauled"},
    )
    named = verdict.isin("wolf", "bear", "animal", "infected", "fall", "vehicle", "explosion")
    ill = F.filter(conditions, lambda c: c != "healthy")
    suicide = (
        F.when(F.size(ill) > 0, F.concat(F.lit("Suicide ("), F.array_join(ill, ", "), F.lit(")")))
        .when(F.array_contains(conditions, "healthy"), "Suicide (in good health)")
        .otherwise("Suicide")
    )
    return (
        F.when(verdict.isNull(), cause_label(cause))
        .when(verdict == "pvp", "Killed")
        .when(named, cause_label(verdict))
        .when(nouns.isNull(), cause_label(cause))
        .when(verdict == "suicide", suicide)
        .when(confidence == "low", F.concat(F.lit("Likely "), F.lower(nouns)))
        .otherwise(nouns)
    )


def is_unrecorded_cause(cause: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(cause, F.lit(""))))
    return text.isin("", "died", "environment", "environmental", "unknown")


def is_melee(weapon: Column) -> Column:
    return F.coalesce(F.lower(F.trim(weapon)).isin(MELEE_WEAPONS), F.lit(False))


def entity_class(label: Column) -> Column:
    """wolf / bear / animal from an entity class name, else null."""
    return (
        F.when(label.startswith("Animal_CanisLupus"), "wolf")
        .when(label.startswith("Animal_UrsusArctos"), "bear")
        .when(label.startswith("Animal_"), "animal")
    )


def is_fire(label: Column) -> Column:
    return F.coalesce(F.lower(label).contains("fire"), F.lit(False))


# --- emotes ------------------------------------------------------------------------------


def emote_token(label: Column) -> Column:
    return _lookup(F.lower(label), {name.lower(): token for name, token, _ in EMOTES})


def emote_label(token: Column) -> Column:
    return _lookup(token, {token: name for name, token, _ in EMOTES})


def emote_is_safe(token: Column) -> Column:
    return F.coalesce(token.isin([token for _, token, safe in EMOTES if safe]), F.lit(False))


# --- map ---------------------------------------------------------------------------------


def grid_ref(x: Column, y: Column) -> Column:
    """``012 105``: hectometre cells, at least three digits and never cut."""

    def cell(v: Column) -> Column:
        return F.format_string("%03d", F.greatest(F.lit(0).cast("long"), F.floor(v / 100)))

    return F.concat_ws(" ", cell(x), cell(y))


def world_size(map_code: Column) -> Column:
    return _lookup(map_code, MAP_WORLD_SIZE)


def world_to_pixel(x: Column, y: Column, size: Column, canvas_px: Column) -> Column:
    scale = canvas_px / size
    return F.struct((x * scale).alias("px"), ((size - y) * scale).alias("py"))


def world_to_latlng(x: Column, y: Column, size: Column, canvas_px: Column, max_zoom: Column) -> Column:
    pixel = world_to_pixel(x, y, size, canvas_px)
    scale = F.pow(F.lit(2.0), max_zoom)
    return F.struct((-pixel["py"] / scale).alias("lat"), (pixel["px"] / scale).alias("lng"))


def map_label(map_code: Column) -> Column:
    return F.coalesce(_lookup(map_code, MAP_LABELS), initcap_words(map_code))


def place_visible(kind: Column, zoom: Column) -> Column:
    return zoom >= F.coalesce(_lookup(kind, PLACE_MIN_ZOOM), F.lit(4))


def is_far(ax: Column, ay: Column, bx: Column, by: Column, meters: float = 15.0) -> Column:
    return F.hypot(ax - bx, ay - by) >= meters


# --- prose -------------------------------------------------------------------------------


def first_sentence(text: Column, limit: int = 120) -> Column:
    """First sentence of a trimmed text; longer ones are cut at ``limit`` with an ellipsis."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    sentence = F.regexp_extract(body, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    first = F.when(sentence == "", body).otherwise(sentence)
    cut = F.regexp_replace(F.substring(first, 1, limit), r"\s+$", "")
    return F.when(F.length(first) > limit, F.concat(cut, F.lit("…"))).otherwise(first)


def ban_names(dayz_id: Column, gamertag: Column) -> Column:
    names = F.filter(F.array(dayz_id, gamertag), lambda n: n.isNotNull() & (F.trim(n) != ""))
    return F.transform(names, lambda n: F.trim(n))


def dedupe_roster(names: Column, min_length: int = 0) -> Column:
    """Trimmed non-blank names, first of each case-insensitive spelling, order kept."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
    keys = F.transform(kept, F.lower)
    first = F.filter(
        F.transform(
            kept, lambda n, i: F.when(F.array_position(keys, F.lower(n)) == i + 1, n)
        ),
        lambda n: n.isNotNull(),
    )
    return F.filter(first, lambda n: F.length(n) >= min_length)


def cause_category_tag(category: Column) -> Column:
    return (
        F.when(category == "pvp", "PvP")
        .when(category == "suicide", "Self-Inflicted")
        .when(category == "environment", "Environment")
        .otherwise("Unknown")
    )


def compose_tags(map_code: Column, category: Column, flavours: Column) -> Column:
    """Three reserved tags, then the first flavour that is not one of them."""
    base = F.array(F.lit("Obituaries"), map_label(map_code), cause_category_tag(category))
    taken = F.transform(base, F.lower)
    free = F.filter(
        F.transform(flavours, lambda t: F.trim(t)), lambda t: (t != "") & ~F.array_contains(taken, F.lower(t))
    )
    return F.concat(base, F.slice(free, 1, 1))


FACTS = (
    "sessions int, killerGamertag string, weapon string, "
    "verdict struct<cause:string,confidence:string,conditions:array<string>>"
)


def read_facts(facts: Column) -> Column:
    """Facts snapshot of an article with its documented defaults."""
    f = F.from_json(facts, FACTS)
    verdict = F.when(
        F.coalesce(f["verdict"]["cause"], F.lit("")) != "",
        F.struct(
            f["verdict"]["cause"].alias("cause"),
            F.coalesce(f["verdict"]["confidence"], F.lit("high")).alias("confidence"),
            F.coalesce(f["verdict"]["conditions"], F.array().cast("array<string>")).alias("conditions"),
        ),
    )
    return F.struct(
        F.coalesce(f["sessions"], F.lit(0)).alias("sessions"),
        f["killerGamertag"].alias("killer_gamertag"),
        f["weapon"].alias("weapon"),
        verdict.alias("verdict"),
    )


REPLY = (
    "headline string, lede string, body string, "
    "pullQuote struct<text:string,attribution:string>, tags array<string>"
)


def salvage_reply(raw: Column) -> Column:
    """Parse a reply, or its first-to-last brace block; null where the shape is not valid."""
    block = F.when(raw.rlike(r"(?s)^\s*\{.*\}\s*$"), raw).otherwise(
        F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))
    )
    r = F.from_json(block, REPLY)
    keys = F.json_object_keys(block)

    def filled(c: Column) -> Column:
        return F.length(F.trim(c)) > 0

    quote_ok = r["pullQuote"].isNull() | (
        filled(r["pullQuote"]["text"]) & filled(r["pullQuote"]["attribution"])
    )
    rules = [
        filled(r["headline"]), F.length(F.trim(r["headline"])) <= 200, filled(r["lede"]),
        filled(r["body"]), F.array_contains(keys, "pullQuote"), quote_ok, F.size(r["tags"]) <= 6,
        r["tags"].isNotNull(), F.forall(r["tags"], filled),
    ]
    return F.when(reduce(Column.__and__, [F.coalesce(x, F.lit(False)) for x in rules]), r)


def encounter_title(category: Column, hits: Column, duration: Column) -> Column:
    blows = _plural(hits, "blow")
    minutes = _minutes(duration)
    return (
        F.when(category == "wolf", F.when(hits >= 3, "Wolves — fought off").otherwise("A wolf — fought off"))
        .when(category == "bear", "A bear — fought off")
        .when(category == "animal", "Wild animal — fought off")
        .when(
            category == "infected",
            F.when(hits >= 3, F.concat(F.lit("Horde — "), hits.cast("string"), F.lit(" blows over "), minutes))
            .otherwise(F.concat(F.lit("Infected — "), blows)),
        )
        .when(category == "player", "Firefight")
        .when(category == "fire", F.concat(F.lit("Burned — "), blows))
        .otherwise(F.concat(F.lit("Took a beating — "), _plural(hits, "hit")))
    )


def encounter_line(category: Column, hits: Column, duration: Column, hp_low: Column) -> Column:
    hp = F.concat(F.lit("HP down to "), round_half_up(hp_low).cast("string"))
    blows = _plural(hits, "blow")
    over = F.concat(blows, F.lit(" over "), _minutes(duration))
    return (
        F.when(category.isin("wolf", "bear"), F.concat_ws(" · ", over, hp))
        .when(category == "animal", F.concat_ws(" · ", blows, hp))
        .when(category == "infected",
              F.coalesce(hp, F.when(hits >= 3, F.lit("Fought clear")).otherwise(blows)))
        .when(
            category == "player",
            F.concat_ws(
                " · ",
                F.concat(_plural(hits, "hit"), F.lit(" taken")),
                F.concat(F.lit("HP "), round_half_up(hp_low).cast("string")),
            ),
        )
        .when(category == "fire", F.coalesce(hp, F.lit("Got clear of the flames")))
        .otherwise(F.coalesce(hp, F.lit("Walked it off")))
    )


def _plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def _minutes(seconds: Column) -> Column:
    return _unit(F.greatest(F.lit(1).cast("long"), round_half_up(seconds / 60)), "m")


def vitals_line(energy: Column, water: Column, bleed_sources: Column) -> Column:
    parts = F.concat_ws(
        " · ",
        F.concat(F.lit("Energy "), round_half_up(energy).cast("string")),
        F.concat(F.lit("Water "), round_half_up(water).cast("string")),
        F.when(bleed_sources > 0, F.concat(F.lit("bleeding ×"), bleed_sources.cast("string"))),
    )
    return F.nullif(parts, F.lit(""))


def rap_sheet(seconds: Column, kills: Column, longest: Column, cause_text: Column) -> Column:
    """Ordered label / value facts; the longest kill only where there is one."""

    def fact(label: str, value: Column, hot: bool) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(hot).alias("hot"))

    rows = F.array(
        fact("Survived", board_duration(seconds), False),
        fact("Kills", kills.cast("string"), False),
        F.when(longest.isNotNull(), fact("Longest kill", _unit(round_half_up(longest), "m"), False)),
        fact("Cause", cause_text, True),
    )
    return F.filter(rows, lambda r: r.isNotNull())
