"""Published articles: obituary feed, article by slug, URL export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import OBITUARIES_PAGE_SIZE
from ..functions.scalars import read_facts
from ..operators.paging import page as page_of
from ..operators.sets import union_all
from .dataset import Dataset

_CARD = [
    "slug", "gamertag", "map", "map_slug", "life_number", "headline", "lede", "tags",
    "time_alive_seconds", "kills", "longest_kill_meters", "cause", "death_at",
]


def published_obituaries(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): a published obituary without subject columns is never served."""
    rows = articles.where((F.col("kind") == "obituary") & (F.col("status") == "published"))
    whole = (
        F.col("gamertag").isNotNull() & F.col("map").isNotNull() & F.col("life_number").isNotNull()
    )
    return rows.where(whole), rows.where(~whole)


def obituaries(articles: DataFrame, page: int = 1, size: int = OBITUARIES_PAGE_SIZE) -> DataFrame:
    """One page of the feed, newest death first."""
    rows, _ = published_obituaries(articles)
    cards = rows.select("id", *_CARD).withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )
    return page_of(cards, [F.col("death_at").desc_nulls_first(), F.col("id").desc()], page, size)


def obituary(articles: DataFrame, slug: str | None = None) -> DataFrame:
    """Articles with body blocks, quote and facts snapshot; one slug or all of them."""
    rows, _ = published_obituaries(articles)
    if slug is not None:
        rows = rows.where(F.col("slug") == slug).limit(1)
    blocks = "array<struct<type:string,text:string,attribution:string,items:array<string>>>"
    quote = F.when(
        F.coalesce("pull_quote_text", F.lit("")) != "",
        F.struct(
            F.col("pull_quote_text").alias("text"),
            F.coalesce("pull_quote_attribution", F.lit("")).alias("attribution"),
        ),
    )
    return rows.select(
        *_CARD, F.coalesce("body", F.lit("")).alias("body"),
        F.from_json("body_blocks", blocks).alias("body_blocks"),
        quote.alias("pull_quote"), read_facts(F.col("facts")).alias("facts"),
    )


def sitemap_entries(d: Dataset) -> DataFrame:
    """Player, life and article addresses with their last change."""
    servers = d["servers"].where(F.col("slug").isNotNull()).select(
        F.col("id").alias("server_id"), F.col("slug").alias("map_slug")
    )
    active = F.coalesce("ended_at", "started_at")
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    players = d.lives_of.groupBy("gamertag").agg(F.max(active).alias("lastmod")).select(
        F.lit("player").alias("kind"), F.col("gamertag").alias("name"), none_s.alias("map_slug"),
        none_i.alias("life_number"), "lastmod",
    )
    lives = d.lives_of.join(servers, "server_id").select(
        F.lit("life").alias("kind"), F.col("gamertag").alias("name"), "map_slug", "life_number",
        active.alias("lastmod"),
    )
    articles = d["articles"].where(
        (F.col("status") == "published") & F.col("slug").isNotNull()
    ).select(
        F.col("kind"), F.col("slug").alias("name"), none_s.alias("map_slug"),
        none_i.alias("life_number"), F.col("created_at").alias("lastmod"),
    )
    return union_all([players, lives, articles])
