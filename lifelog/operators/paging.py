"""Sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked


def clamp_page(page: Column, total: Column, size: int) -> Column:
    """Requested page forced into 1..last page (at least one page)."""
    last = F.greatest(F.lit(1).cast("long"), F.ceil(total / size))
    return F.least(F.greatest(page, F.lit(1)).cast("long"), last)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with the overall ``total``; the count is a one-row scalar subquery."""
    total = df.agg(F.count("*").alias("n")).scalar()
    number = max(1, int(number) or 1)
    return ranked(df, order, size, (number - 1) * size).withColumn("total", total)


def by_label(column: str) -> Column:
    """Labels in the order of a reader: letters before case and accents, not by code point."""
    return F.collate(F.col(column), "UNICODE").asc()


def survivor_order() -> list[Column]:
    """Longest alive first, then kills, then longest kill (none last), then label."""
    return [
        F.col("time_alive_seconds").desc(),
        F.col("kills_this_life").desc(),
        F.col("longest_kill_meters").desc_nulls_last(),
        by_label("gamertag"),
    ]


def order_servers(servers: DataFrame) -> DataFrame:
    return servers.where("active").orderBy(F.lower("name"), "id")


def presence_rank(is_self: Column, sharing: Column) -> Column:
    return F.when(is_self, 0).when(sharing, 1).otherwise(2)
