"""Ordered scans that stay balanced when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  The scans here
partition by ``(key, slice)`` instead, where a slice is a fixed range of the ordering value,
and carry a one-row summary per (key, slice) across slices:

1. per-slice summary      groupBy(key, slice)            map-side combined
2. carry into each slice  window over the summaries      one row per slice, not per event
3. local scan + carry     window over (key, slice)       bounded by the slice width

Ordering by ``event_id`` bounds a slice by ``SLICE_EVENTS`` rows whatever the key skew is.
Ordering by time, a slice is a fixed stretch of time; a stretch in which one key has more than
``SLICE_ROWS`` rows is cut into slices of equal depth, see ``sliced_by_time``.
Where no key has more than ``PLAIN_ROWS`` rows a key is one slice: a plain window gives the same values
without summary, carry and join.  One count by key decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

SLICE_EVENTS = 4_000_000
SLICE_SECONDS = 3_600
#: Rows of one key in a stretch of time, above which the stretch is cut.
SLICE_ROWS = 4_000_000
#: Rows of a key up to which it needs no slices.
PLAIN_ROWS = 200_000
#: Slices that one stretch may be cut into; they follow the stretch in one number.
STRETCH_SLICES = 1 << 20

_SLICE = "__slice"


def event_slice(column: str = "event_id", width: int = SLICE_EVENTS) -> Column:
    """Slice of an integer ordering column.

    Event ids are a dense sequence, so a slice holds at most ``width`` events of any key.
    """
    return F.expr(f"`{column}` div {width}")


@dataclass(frozen=True)
class TimeSlice:
    """Slices of a timestamp ordering column: stretches of ``seconds``, cut where a key is dense."""

    column: str
    seconds: int


def time_slice(column: str, seconds: int = SLICE_SECONDS) -> TimeSlice:
    return TimeSlice(column, seconds)


def sliced_by_time(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: int, name: str = _SLICE, rows: int | None = None
) -> DataFrame:
    """Add the slice of each row: a number that rises with ``order`` within a key.

    A slice is a stretch of ``seconds`` of ``order[0]``.  A stretch with more than ``rows`` rows of one
    key is cut at equal depth: a histogram of its seconds gives each second the number of rows before it,
    and a new slice begins every ``rows`` rows.  Seconds that hold more than ``rows`` rows themselves are
    counted by microsecond, and such microseconds by the rest of ``order``, whose last column is a number.
    So a slice holds at most twice ``rows`` rows, whatever the skew, but for rows that ``order`` cannot
    tell apart.

    One count by stretch finds the dense stretches; without any, nothing else is read.  A histogram is
    summed within its stretch (its second, its microsecond), never for a key as a whole.
    """
    keys, rows = list(keys), rows or SLICE_ROWS
    marked = df.withColumn("__micro", F.unix_micros(F.col(order[0])))
    marked = marked.withColumn("__stretch", F.expr(f"__micro div {seconds * 1_000_000}"))
    dense = marked.groupBy(*keys, "__stretch").count().where(F.col("count") > rows)
    start = F.col("__stretch") * STRETCH_SLICES
    if not dense.limit(1).count():
        return marked.withColumn(name, start).drop("__micro", "__stretch")

    marked = marked.withColumn("__second", F.expr("__micro div 1000000"))
    levels = [("__stretch", "__second"), ("__second", "__micro")]
    if len(order) > 1:
        last = order[-1]
        block = F.expr(f"`{last}` div {rows}") if dict(df.dtypes)[last] in ("int", "bigint") else F.col(last)
        marked = marked.withColumn("__block", F.struct(*order[1:-1], block.alias("__last")))
        levels.append(("__micro", "__block"))
    hot = stage(dense.select(*keys, "__stretch", F.lit(0).cast("long").alias("__before")), "slices")
    sliced, before = marked, F.lit(0).cast("long")
    for number, (parent, cell) in enumerate(levels):
        earlier = Window.partitionBy(*keys, parent).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        counted = marked.join(hot, [*keys, parent]).groupBy(*keys, parent, cell).agg(
            F.count("*").alias("__rows"), F.first("__before").alias("__before"))
        counted = stage(
            counted.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__rows").over(earlier), F.lit(0))), "slices")
        sliced = sliced.join(counted.select(*keys, parent, cell, F.col("__before").alias(f"__before{number}")), [*keys, parent, cell], "left")
        before = F.coalesce(F.col(f"__before{number}"), before)
        hot = counted.where(F.col("__rows") > rows).select(*keys, cell, "__before")
        if not hot.limit(1).count():
            break
    return sliced.withColumn(name, start + F.floor(before / rows)).select(*df.columns, name)


@dataclass(frozen=True)
class Scan:
    """One running value.

    kind is one of
      ``prev``  last non-null value on an earlier row
      ``upto``  last non-null value on an earlier row or this one
      ``next``  first non-null value on a later row
      ``sum`` / ``sum_before``  running total with / without this row (0 when empty)
      ``max_before``  running maximum of the earlier rows
    """

    kind: str
    value: Column


def prev(value: Column) -> Scan:
    return Scan("prev", value)


def upto(value: Column) -> Scan:
    return Scan("upto", value)


def following(value: Column) -> Scan:
    return Scan("next", value)


def running_sum(value: Column) -> Scan:
    return Scan("sum", value)


def sum_before(value: Column) -> Scan:
    return Scan("sum_before", value)


def max_before(value: Column) -> Scan:
    return Scan("max_before", value)


def _plain(df: DataFrame, keys: list[str], at: str) -> bool:
    """Whether every key is small.  Rows with a null key or place keep to their slices, which never join."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__rows"), F.count_if(F.col(at).isNull()).alias("__nulls"))
    null = reduce(Column.__or__, [F.col(k).isNull() for k in keys]) | (F.col("__nulls") > 0)
    largest, nulls = sizes.agg(F.max("__rows"), F.bool_or(null)).first()
    return not nulls and (largest or 0) <= PLAIN_ROWS


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column | TimeSlice,
    **scans: Scan,
) -> DataFrame:
    """Add one column per scan.  ``order`` names columns that order the rows of a key totally."""
    keys, order = list(keys), list(order)
    plain = _plain(df, keys, order[0])
    if plain:
        work = df.withColumn(_SLICE, F.lit(0).cast("long"))
    elif isinstance(slice_by, TimeSlice):
        work = sliced_by_time(df, keys, order, slice_by.seconds)
    else:
        work = df.withColumn(_SLICE, slice_by)
    work = work.withColumns({f"__v_{n}": s.value for n, s in scans.items()})

    # A single ordering column keeps the summary in a hash aggregate; structs need a sorted one.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    forward = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    backward = Window.partitionBy(*keys, _SLICE).orderBy(*[F.col(c).desc() for c in order])
    earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
    so_far = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = backward.rowsBetween(Window.unboundedPreceding, -1)

    slices = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    slices_back = (
        Window.partitionBy(*keys).orderBy(F.col(_SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )

    summaries, carries, local, final = [], [], {}, {}
    for name, scan in scans.items():
        value = F.col(f"__v_{name}")
        summary, carry = f"__s_{name}", F.col(f"__c_{name}")
        at = F.when(value.isNotNull(), place)
        if scan.kind in ("prev", "upto"):
            summaries.append(F.max_by(value, at).alias(summary))
            carries.append(F.last(summary, ignorenulls=True).over(slices).alias(f"__c_{name}"))
            frame = earlier if scan.kind == "prev" else so_far
            local[f"__l_{name}"] = F.last(value, ignorenulls=True).over(frame)
            final[name] = F.coalesce(F.col(f"__l_{name}"), carry)
        elif scan.kind == "next":
            summaries.append(F.min_by(value, at).alias(summary))
            carries.append(F.last(summary, ignorenulls=True).over(slices_back).alias(f"__c_{name}"))
            local[f"__l_{name}"] = F.last(value, ignorenulls=True).over(later)
            final[name] = F.coalesce(F.col(f"__l_{name}"), carry)
        elif scan.kind in ("sum", "sum_before"):
            summaries.append(F.sum(value).alias(summary))
            carries.append(F.sum(summary).over(slices).alias(f"__c_{name}"))
            frame = so_far if scan.kind == "sum" else earlier
            local[f"__l_{name}"] = F.sum(value).over(frame)
            final[name] = F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif scan.kind == "max_before":
            summaries.append(F.max(value).alias(summary))
            carries.append(F.max(summary).over(slices).alias(f"__c_{name}"))
            local[f"__l_{name}"] = F.max(value).over(earlier)
            final[name] = F.greatest(F.col(f"__l_{name}"), carry)
        else:
            raise ValueError(f"unknown scan kind {scan.kind!r}")

    if plain:
        scanned = work.withColumns(local).withColumns({f"__c_{n}": F.lit(None).cast(t) for n, t in _carry_types(work, scans)})
        return scanned.select(*df.columns, *[final[name].alias(name) for name in scans])

    carried = [f"__c_{name}" for name in scans]
    # Slices without any value keep their summary row: their rows still need what is carried in.
    carry_rows = (
        work.groupBy(*keys, _SLICE)
        .agg(*summaries)
        .select(*keys, _SLICE, *carries)
        .where(reduce(Column.__or__, [F.col(c).isNotNull() for c in carried]))
    )
    joined = work.withColumns(local).join(carry_rows, [*keys, _SLICE], "left")
    return joined.select(*df.columns, *[final[name].alias(name) for name in scans])


def _carry_types(work: DataFrame, scans: dict[str, Scan]) -> list[tuple]:
    summed = work.agg(*[
        (F.sum if s.kind.startswith("sum") else F.max)(f"__v_{n}").alias(n) for n, s in scans.items()])
    return [(n, summed.schema[n].dataType) for n in scans]


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest under ``order``.

    An aggregate rather than ``row_number``, so copies combine map-side and a hot key never
    has to be sorted in one task.  Null ordering values rank lowest.
    """
    return _pick(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest under ``order``.  Null ordering values rank lowest."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, chooser) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("__row"))
    return chosen.select(*keys, "__row.*").select(*df.columns)


def ranked(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Global top-k page; Spark plans it as TakeOrdered, so no full sort is shuffled."""
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the shuffle, so a
    hot key sends at most k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
