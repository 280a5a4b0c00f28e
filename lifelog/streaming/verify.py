"""Challenge matching as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "label string, challenge_id long, link_id long, event_id long, progress_index int, status string"
_STATE = "progress array<struct<challenge_id:long,at:int,last:long>>, winner long"


def stream_verify(emotes: DataFrame, challenges: DataFrame, links: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Progress and outcome rows of pending challenges as emotes arrive.

    ``emotes(event_id, gamertag, emote, occurred_at)`` is a stream, ``challenges`` and ``links``
    are tables.  Each micro-batch joins the emotes of a label with its pending challenges, so a
    Python group holds the matching tokens of one label and batch, not its history.  Replays are
    harmless: a challenge only advances on event ids above its last match.
    """
    pending = challenges.where(F.col("completed_at").isNull()).select(
        F.col("id").alias("challenge_id"), F.col("gamertag_link_id").alias("link_id"), "sequence",
        "issued_at", "expires_at",
    )
    open_links = links.where(F.col("status") == "pending").select(
        F.col("id").alias("link_id"), F.lower("gamertag").alias("label")
    )
    owned = links.where(F.col("status") == "verified").select(
        F.lower("gamertag").alias("label")
    ).distinct().withColumn("owned", F.lit(True))
    targets = pending.join(open_links, "link_id").join(owned, "label", "left").fillna(False, ["owned"])
    tokens = emotes.withWatermark("occurred_at", lateness).select(
        F.lower("gamertag").alias("label"), "emote", "event_id", "occurred_at"
    )
    candidates = tokens.join(targets, "label").where(
        (F.col("issued_at") < F.col("occurred_at")) & (F.col("expires_at") > F.col("occurred_at"))
        & F.array_contains("sequence", F.col("emote"))
    ).select("label", "event_id", "occurred_at", "emote", "challenge_id", "link_id", "sequence",
             "owned", "expires_at")
    return candidates.groupBy("label").applyInPandasWithState(
        _advance, _OUT, _STATE, "append", "EventTimeTimeout"
    )


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["event_id", "link_id"])
    progress, winner = ({}, None)
    if state.exists:
        kept, winner = state.get
        progress = {int(p[0]): (int(p[1]), int(p[2])) for p in kept}
    out = []
    deadline = 0
    won_at = None
    for r in rows.itertuples(index=False):
        deadline = max(deadline, int(r.expires_at.timestamp() * 1000))
        # Rivals listed for the winning emote itself still see it; later emotes reach nobody.
        if winner is not None and r.event_id != won_at:
            continue
        step, last = progress.get(r.challenge_id, (0, 0))
        if r.event_id <= last or step >= len(r.sequence) or r.sequence[step] != r.emote:
            continue
        step += 1
        progress[r.challenge_id] = (step, r.event_id)
        status = "pending"
        if step == len(r.sequence):
            if r.owned or winner is not None:
                status = "cancelled"
            else:
                status, winner, won_at = "verified", int(r.link_id), r.event_id
        out.append((key[0], r.challenge_id, r.link_id, r.event_id, step, status))
    state.update(([(c, s, e) for c, (s, e) in progress.items()], winner))
    if deadline > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(deadline)
    if out:
        yield pd.DataFrame(
            out, columns=["label", "challenge_id", "link_id", "event_id", "progress_index", "status"]
        )
