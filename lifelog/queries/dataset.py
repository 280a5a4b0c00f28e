"""Tables of one deployment plus the per-life facts most queries share."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import ENCOUNTER_GAP_SECONDS, FRESH_SECONDS, QUALIFY_SECONDS, RECENT_WINDOW_SECONDS
from ..functions.scalars import instant, live_playtime
from ..operators.filters import is_qualified
from ..operators.joins import (
    kill_summary,
    life_hits,
    life_kills,
    life_knockouts,
    with_open_session,
    with_players,
)
from ..operators.tracks import thin_track
from ..operators.windows import qualified_at
from ..staging import stage


class Dataset:
    """``tables`` maps table names to DataFrames; ``now`` is the query instant (UTC).

    Thresholds default to the documented constants.  Facts that several queries read are staged
    once per data set.
    """

    def __init__(
        self,
        tables: dict[str, DataFrame],
        now: datetime,
        *,
        qualify_seconds: int = QUALIFY_SECONDS,
        gap_seconds: float = ENCOUNTER_GAP_SECONDS,
        recent_seconds: float = RECENT_WINDOW_SECONDS,
        fresh_seconds: float = FRESH_SECONDS,
    ):
        self.tables = tables
        self.now_value = now
        self.qualify_seconds = qualify_seconds
        self.gap_seconds = gap_seconds
        self.recent_seconds = recent_seconds
        self.fresh_seconds = fresh_seconds

    def prepare(self) -> None:
        """Stage the shared facts, those that do not read each other at the same time."""
        for group in (
            ("lives_of", "life_kills", "label_kills"),
            ("life_hits", "life_knockouts", "life_status", "life_fixes"),
            ("qualified_at", "verdicts", "encounters", "thinned_fixes"),
            ("priors",),
        ):
            with ThreadPoolExecutor(len(group)) as pool:
                list(pool.map(lambda name: getattr(self, name), group))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def now(self) -> Column:
        return instant(self.now_value)

    @cached_property
    def last_seen(self) -> DataFrame:
        return self["players"].select(F.col("id").alias("player_id"), "last_seen_at")

    @cached_property
    def lives_of(self) -> DataFrame:
        """Lives with the player's current label, account hash and heartbeat."""
        return stage(with_players(self["lives"], self["players"]), "lives-of")

    @cached_property
    def life_kills(self) -> DataFrame:
        """Kills inside the killer's life, by identity; open lives take every later kill."""
        return stage(life_kills(self["lives"], self["kills"]), "life-kills")

    @cached_property
    def label_kills(self) -> DataFrame:
        """Kills inside a life of whoever now carries the name on the kill."""
        return stage(
            life_kills(self["lives"], self["kills"], by="label", players=self["players"]),
            "label-kills",
        )

    @cached_property
    def life_hits(self) -> DataFrame:
        """Hits taken inside a life; an open life reaches to the heartbeat."""
        windowed = self.lives_of.withColumn(
            "until", F.coalesce("ended_at", "last_seen_at", self.now)
        )
        return stage(life_hits(windowed, self["hit_events"], end="until"), "life-hits")

    @cached_property
    def life_knockouts(self) -> DataFrame:
        windowed = self["lives"].withColumn("until", F.coalesce("ended_at", "started_at"))
        return stage(
            life_knockouts(windowed, self["unconscious_events"], end="until"), "life-knockouts"
        )

    @cached_property
    def life_status(self) -> DataFrame:
        """One row per life: effective play time, kills in the life and whether it qualifies.

        Kills of an open life count up to the heartbeat for qualification (``kills_counted``)
        and without an upper bound for display (``kills``).
        """
        rows = with_open_session(self.lives_of, self["sessions"])
        up_to = F.coalesce("last_seen_at", "connected_at", self.now)
        rows = rows.withColumn("up_to", up_to).withColumn(
            "seconds",
            F.when(F.col("ended_at").isNotNull(), F.col("playtime_seconds")).otherwise(
                live_playtime(F.col("playtime_seconds"), F.col("connected_at"), up_to)
            ),
        )
        summary = kill_summary(self.life_kills).withColumnRenamed("life_id", "id")
        counted = (
            self.life_kills.join(
                rows.select(F.col("id").alias("life_id"), F.coalesce("ended_at", "up_to").alias("stop")),
                "life_id",
            )
            .where(F.col("occurred_at") <= F.col("stop"))
            .groupBy(F.col("life_id").alias("id")).agg(F.count("*").alias("kills_counted"))
        )
        rows = rows.join(summary, "id", "left").join(counted, "id", "left")
        rows = rows.fillna(0, ["kills", "kills_counted"])
        return stage(
            rows.withColumn(
                "qualified",
                is_qualified(
                    F.col("death_cause"), F.col("kills_counted"), F.col("seconds"), self.qualify_seconds
                ),
            ),
            "life-status",
        )

    @cached_property
    def qualified_at(self) -> DataFrame:
        return stage(
            qualified_at(
                self["lives"], self["sessions"], self.life_kills, self.last_seen, self.qualify_seconds
            ),
            "qualified-at",
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        from .lives import death_verdicts

        return stage(death_verdicts(self), "verdicts")

    @cached_property
    def encounters(self) -> DataFrame:
        from .lives import encounters_of

        return stage(encounters_of(self), "encounters")

    @cached_property
    def life_fixes(self) -> DataFrame:
        from .lives import life_fixes

        return stage(life_fixes(self), "life-fixes")

    @cached_property
    def thinned_fixes(self) -> DataFrame:
        points = self.life_fixes.select("life_id", "event_id", "x", "y", "recorded_at")
        return stage(thin_track(points), "thin-track")

    @cached_property
    def priors(self) -> DataFrame:
        from .players import player_priors

        return stage(player_priors(self), "priors")
