"""As-of and interval joins built on the balanced ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .ordered import TimeSlice, event_slice, following, max_before, ordered_scan, prev, running_sum, time_slice

#: Points under one node of an interval's segments, as a power of two.
SEGMENT_LEVELS = 20


def _slice_for(df: DataFrame, column: str, name: str) -> Column | TimeSlice:
    return time_slice(name) if dict(df.dtypes)[column].startswith("timestamp") else event_slice(name)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    match: str,
    *,
    direction: str = "backward",
    strict: bool = False,
    tie: Column | None = None,
) -> DataFrame:
    """Attach to every left row the nearest right row of the same keys, as struct ``match``.

    backward: greatest ``right_at`` <= ``left_at`` (< when strict); forward: the mirror image.
    ``tie`` ranks right rows that share an instant; the highest rank is nearest.
    Linear in both inputs: left and right are unioned and scanned once, nothing fans out.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    lefts = left.select(
        *keys,
        F.col(left_at).alias("__at"),
        F.struct(*left.columns).alias("__left"),
        F.lit(True).alias("__is_left"),
    )
    rights = right.select(
        *keys,
        F.col(right_at).alias("__at"),
        F.struct(*rest).alias("__right"),
        F.lit(False).alias("__is_left"),
        (F.lit(0).cast("long") if tie is None else tie.cast("long")).alias("__tie"),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    # On equal instants the right row must come before the left row exactly when it may match.
    right_first = (direction == "backward") != strict
    both = both.withColumn("__side", F.when(F.col("__is_left") == F.lit(right_first), 1).otherwise(0))
    both = both.withColumn("__tie", F.coalesce("__tie", F.lit(0).cast("long")))
    if direction == "forward":
        both = both.withColumn("__tie", -F.col("__tie"))
    scan = prev(F.col("__right")) if direction == "backward" else following(F.col("__right"))
    scanned = ordered_scan(
        both, keys, ["__at", "__side", "__tie"], _slice_for(both, "__at", "__at"), __match=scan
    )
    return scanned.where("__is_left").select("__left.*", F.col("__match").alias(match))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    match: str,
    *,
    tie: str,
    end_inclusive: bool = True,
) -> DataFrame:
    """Every (point, interval) pair with start <= at <= end; a null end is open.

    Intervals of a key are mostly disjoint, as lives and sessions are: the as-of step matches each point
    to the latest-starting interval without fan-out.  Where an interval reaches past the start of its
    successor, ``covering`` joins the shared part, in time proportional to the pairs it finds, so touching,
    overlapping and nested intervals give exactly the pairs of the plain range join.
    ``tie`` is a unique long column of ``intervals``.
    """
    keys = list(keys)

    def inside(t: Column, stop: Column) -> Column:
        return stop.isNull() | ((t <= stop) if end_inclusive else (t < stop))

    nearest = asof_join(points, intervals, keys, at, start, match, tie=F.col(tie))
    nearest = nearest.where(
        F.col(match).isNotNull() & inside(F.col(at), F.col(match)[end])
    )

    spans = ordered_scan(
        intervals,
        keys,
        [start, tie],
        _slice_for(intervals, start, start),
        __successor=following(F.col(start)),
    )
    rest = [c for c in intervals.columns if c not in keys]
    shared = stage(
        spans.where(F.col("__successor").isNotNull() & inside(F.col("__successor"), F.col(end)))
        .select(*keys, "__successor", F.col(end).alias("__stop"), F.col(tie).alias("__tie"), F.struct(*rest).alias(match)),
        "shared-spans",
    )
    if not shared.limit(1).count():
        return nearest
    return nearest.unionByName(covering(points, shared, keys, at, match, end_inclusive))


def covering(
    points: DataFrame, spans: DataFrame, keys: list[str], at: str, match: str, end_inclusive: bool = True
) -> DataFrame:
    """Every (point, span) pair of a key with the point inside, whatever the overlap of the spans.

    ``spans(keys, __successor, __stop, __tie, match)``: first and last instant, a null last one is open.

    One scan over points and borders numbers the points that some span covers, and gives each border the
    number of points before it; a span is then a range of point numbers.  A range falls into a few dyadic
    segments - blocks of 2^level points that begin at a multiple of 2^level - and a point lies in one
    segment of each level, so an equi-join on (key, level, segment) finds each pair once and meets no
    other.  A segment holds at most 2^``SEGMENT_LEVELS`` points, so no key is joined in one task.
    """
    # Only points of keys that have spans, between the first and the last instant of them.
    edges = spans.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.min("__successor").alias("__low"), F.max("__stop").alias("__high"), F.max(F.col("__stop").isNull()).alias("__open"))
    near = points.join(
        edges, [F.col(k) == F.col(f"__k_{k}") for k in keys]
        + [F.col(at) >= F.col("__low"), F.col("__open") | (F.col(at) <= F.col("__high"))], "left_semi")

    # At one instant: a span that ends there closes after the points if the end belongs to it, else first of all.
    opens, point, closes = (0, 1, 2) if end_inclusive else (1, 2, 0)
    real = spans if end_inclusive else spans.where(F.col("__stop").isNull() | (F.col("__stop") > F.col("__successor")))
    order = ["__at", "__side", "__tie"]

    def border(column: str, side: int, depth: int) -> DataFrame:
        return real.where(F.col(column).isNotNull()).select(
            *keys, F.col(column).alias("__at"), F.lit(side).alias("__side"), "__tie", F.lit(depth).alias("__depth"))

    here = near.select(
        *keys, F.col(at).alias("__at"), F.lit(point).alias("__side"), F.monotonically_increasing_id().alias("__tie"),
        F.lit(0).alias("__depth"), F.struct(*points.columns).alias("__point"))
    both = stage(
        here.unionByName(border("__successor", opens, 1), allowMissingColumns=True)
        .unionByName(border("__stop", closes, -1), allowMissingColumns=True), "covering-rows")
    depth = ordered_scan(both, keys, order, _slice_for(both, "__at", "__at"), __cover=running_sum(F.col("__depth").cast("long")))
    counted = (F.col("__side") == point) & (F.col("__cover") > 0)
    covered = stage(depth.where((F.col("__side") != point) | (F.col("__cover") > 0)), "covering-rows")
    placed = stage(
        ordered_scan(covered, keys, order, _slice_for(covered, "__at", "__at"), __number=running_sum(counted.cast("long"))),
        "covering-rows")

    # Points are numbered from 0 in their key; a border has the number of the next point.
    numbers = placed.where(counted).select(*keys, (F.col("__number") - 1).alias("__number"), "__point")
    last = numbers.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.max("__number").alias("__last"))
    borders = placed.where(F.col("__side") != point).groupBy(*keys, "__tie").agg(
        F.min(F.when(F.col("__depth") > 0, F.col("__number"))).alias("__from"),
        F.max(F.when(F.col("__depth") < 0, F.col("__number"))).alias("__to"))
    ranges = borders.join(last, [F.col(k) == F.col(f"__k_{k}") for k in keys]).select(
        *keys, "__tie", "__from", F.coalesce("__to", F.col("__last") + 1).alias("__to"))
    top = min(SEGMENT_LEVELS, (numbers.agg(F.max("__number")).first()[0] or 0).bit_length())
    # The ends of a range move inwards level by level; an end that has no twin is a segment of its level.
    low, high = "((__from + shiftleft(1L, k) - 1) div shiftleft(1L, k))", "(__to div shiftleft(1L, k))"
    segments = F.expr(f"""
        filter(flatten(transform(sequence(0, {top}), k -> CASE
            WHEN {low} >= {high} THEN array()
            WHEN k = {top} THEN transform(sequence({low}, {high} - 1), s -> struct(k AS level, s AS segment))
            ELSE array(CASE WHEN {low} % 2 = 1 THEN struct(k AS level, {low} AS segment) END,
                       CASE WHEN {high} % 2 = 1 THEN struct(k AS level, {high} - 1 AS segment) END) END)), s -> s IS NOT NULL)""")
    cut = ranges.where("__from < __to").select(*keys, "__tie", F.inline(segments))
    named = cut.join(spans.select(*keys, "__tie", match), [*keys, "__tie"]).drop("__tie")
    above = F.expr(f"transform(sequence(0, {top}), k -> struct(k AS level, __number div shiftleft(1L, k) AS segment))")
    reached = numbers.select(*keys, "__point", F.inline(above))
    return reached.join(named, [*keys, "level", "segment"]).select("__point.*", match)


def islands(
    df: DataFrame, keys: Sequence[str], at: str, tie: str, gap_seconds: float, name: str = "island"
) -> DataFrame:
    """Gaps-and-islands: number the runs of a key; a gap of MORE than ``gap_seconds`` splits."""
    order = [at, tie]
    cut = ordered_scan(df, keys, order, _slice_for(df, at, at), __before=prev(F.col(at)))
    gap_micros = int(gap_seconds * 1_000_000)
    opens = F.when(
        F.col("__before").isNull()
        | (F.unix_micros(at) - F.unix_micros("__before") > F.lit(gap_micros)),
        1,
    ).otherwise(0)
    marked = cut.withColumn("__opens", opens)
    out = ordered_scan(marked, keys, order, _slice_for(df, at, at), **{name: running_sum(F.col("__opens"))})
    return out.drop("__before", "__opens")


__all__ = ["asof_join", "interval_join", "islands", "max_before"]


_OPEN_END = (1 << 63) - 1


def last_open_span(
    points: DataFrame,
    spans: DataFrame,
    keys: list[str],
    at: str,
    start: str,
    stop: str,
    match: str,
    *,
    fan: int = 64,
) -> DataFrame:
    """Each point with the span of its key that started last before it and is still open.

    A span is open at a point when ``stop`` is null or later.  ``at``, ``start`` and ``stop`` are
    non-negative integers.  ``match`` becomes a struct of the span's other columns, null without one.

    Starts are cut into blocks of ``fan``, blocks into blocks of ``fan`` blocks, and so on; every block
    knows the latest stop of its children.  A point climbs until an earlier sibling holds a span that
    outlives it and descends to the last such span.  Each step is one equi-join with at most ``fan``
    children, so overlapping spans of one key never meet pairwise and a hot key spreads over its blocks.
    """
    rest = [c for c in spans.columns if c not in keys and c not in (start, stop)]
    leaf = spans.select(
        *keys, F.col(start).alias("i"), F.coalesce(F.col(stop), F.lit(_OPEN_END)).alias("l"), F.struct(*rest).alias("v")
    )
    # One block at the top holds every start and every point.
    highest = max(df.agg(F.max(column)).first()[0] or 0 for df, column in ((spans, start), (points, at)))
    levels, child = [], leaf
    while not levels or highest:
        parts = ["i", "l"] if levels else ["i", "l", "v"]
        level = stage(
            child.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.expr(f"i div {fan}").alias("__block")).agg(
                F.array_sort(F.collect_list(F.struct(*parts))).alias("__kids"), F.max("l").alias("__latest")
            ),
            "open-spans",
        )
        levels.append(level)
        child = level.select(
            *[F.col(f"__{k}").alias(k) for k in keys], F.col("__block").alias("i"), F.col("__latest").alias("l")
        )
        highest //= fan

    def seek(rows: DataFrame, number: int, block: Column, before: Column | None) -> DataFrame:
        """Join a level and take the last child open at the point (and before ``before``)."""
        same = [F.col(k) == F.col(f"__{k}") for k in keys] + [block == F.col("__block")]
        joined = rows.join(levels[number], same, "left")

        def fits(kid: Column) -> Column:
            return (kid["l"] > F.col(at)) & (F.lit(True) if before is None else kid["i"] < before)

        pick = F.try_element_at(F.filter("__kids", fits), F.lit(-1))
        return joined.withColumn("__pick", pick).drop(*[f"__{k}" for k in keys], "__block", "__kids", "__latest")

    found, open_ = [], points
    for number in range(len(levels)):
        step = F.expr(f"`{at}` div {fan ** number}")
        up = seek(open_, number, F.expr(f"`{at}` div {fan ** (number + 1)}"), step)
        up = stage(up.withColumn("__i", F.col("__pick.i")), "open-points")
        found.append(up.where(F.col("__i").isNotNull()))
        open_ = up.where(F.col("__i").isNull()).select(*points.columns)
    here = None
    for number in range(len(levels) - 1, 0, -1):
        known = found[number].select(*points.columns, "__i")
        here = known if here is None else here.unionByName(known)
        down = seek(here, number - 1, F.col("__i"), None)
        if number == 1:
            here = down.select(*points.columns, F.col("__pick.v").alias(match))
        else:
            here = down.select(*points.columns, F.col("__pick.i").alias("__i"))
    near = found[0].select(*points.columns, F.col("__pick.v").alias(match))
    none = open_.withColumn(match, F.lit(None).cast(leaf.schema["v"].dataType))
    out = near.unionByName(none)
    return out if here is None else out.unionByName(here)
