"""Effects of a verification on rival links and location shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verification_effects(
    wins: DataFrame, links: DataFrame, shares: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(links to cancel, shares to delete) for ``wins(link_id)``.

    Pending links on a won label lose; the winner's outbound shares end.
    """
    won = wins.join(links.withColumnRenamed("id", "link_id"), "link_id").select(
        "link_id", "user_id", F.lower("gamertag").alias("label")
    )
    pending = links.where(F.col("status") == "pending").withColumn("label", F.lower("gamertag"))
    rivals = (
        pending.join(won.select("label").distinct(), "label", "left_semi")
        .join(won.select(F.col("link_id").alias("id")), "id", "left_anti")
        .select("id", "user_id", "gamertag")
    )
    ended = shares.join(
        won.select(F.col("user_id").alias("granter_user_id")).distinct(), "granter_user_id", "left_semi"
    )
    return rivals, ended
