"""Sequential per-key operators on bounded pieces: track thinning and challenge matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import THIN_METERS
from ..staging import stage
from .ordered import first_by, ordered_scan, running_sum, time_slice

PIECE_ROWS = 20_000
#: Children of a block of the search tree over pieces.
FAN = 64
#: Kept points are gathered in chunks of this size, so that appending stays cheap.
CHUNK = 256


def thin_track(
    points: DataFrame,
    key: str = "life_id",
    *,
    meters: float = THIN_METERS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Keep a point when it lies at least ``meters`` from the last KEPT point of its track.

    The last point is always kept.  ``points(key, event_id, x, y, recorded_at)``; every kept point
    is returned, however long the track.

    A track is cut into numbered pieces of at most ``piece_rows`` points.  Which point is kept after a
    kept point depends on that point alone, so a piece needs no more than the last kept point before it
    (``piece_entries``); all pieces are then walked at the same time.  Tracks of one piece, nearly all,
    need no entry.
    """
    ranked = ordered_scan(
        points.select(key, "event_id", "x", "y", "recorded_at"), [key], ["recorded_at", "event_id"],
        time_slice("recorded_at"), ordinal=running_sum(F.lit(1).cast("long")),
    )
    point = F.struct("recorded_at", "event_id", "x", "y")
    pieces = stage(
        ranked.withColumn("piece", F.expr(f"(ordinal - 1) div {piece_rows}"))
        .groupBy(key, "piece").agg(F.sort_array(F.collect_list(point)).alias("points")),
        "track-pieces",
    )
    point_type = "struct<recorded_at:timestamp,event_id:bigint,x:double,y:double>"

    def step(acc, p):
        dx, dy = p["x"] - acc["x"], p["y"] - acc["y"]
        far = acc["x"].isNull() | (F.sqrt(dx * dx + dy * dy) >= meters)
        full = far & (F.size(acc["open"]) >= CHUNK)
        return F.struct(
            F.when(far, p["x"]).otherwise(acc["x"]).alias("x"),
            F.when(far, p["y"]).otherwise(acc["y"]).alias("y"),
            F.when(full, F.array_append(acc["chunks"], acc["open"])).otherwise(acc["chunks"]).alias("chunks"),
            F.when(full, F.array(p)).when(far, F.array_append(acc["open"], p)).otherwise(acc["open"]).alias("open"),
        )

    start = F.struct(
        "x", "y", F.array().cast(f"array<array<{point_type}>>").alias("chunks"),
        F.array().cast(f"array<{point_type}>").alias("open"),
    )
    none = F.lit(None).cast("double")
    entered = pieces.where("piece = 0").withColumns({"x": none, "y": none})
    if pieces.where("piece > 0").limit(1).count():
        entered = entered.unionByName(pieces.join(piece_entries(pieces, key, meters), [key, "piece"]))
    walked = entered.select(key, F.aggregate("points", start, step).alias("a"))
    body = walked.select(key, F.inline(F.flatten(F.array_append("a.chunks", F.col("a.open")))))
    last = points.groupBy(key).agg(F.max(point).alias("last")).select(key, "last.*")
    return body.unionByName(last).distinct()


def piece_entries(pieces: DataFrame, key: str, meters: float, fan: int = FAN) -> DataFrame:
    """(key, piece, x, y): the last kept point before each piece after the first that keeps a point.

    Every piece tabulates which of its points can be the last one kept in it (a walk that enters at any
    point ends in one of them; walks meet soon, so they are few) and its convex hull.  The piece that such
    a point leaves for is the first later one with a hull corner ``meters`` away, found by a search tree
    over the hulls; the point it is left for, and the last one kept after that, are looked up there.  That
    gives a jump from each such point to the next; jumps are doubled, and the jumps made from the start of
    the track are collected from the longest to the shortest.  So the number of rounds grows with the
    logarithm of the number of pieces.
    """
    long_ = stage(
        pieces.join(pieces.where("piece > 0").select(key).distinct(), key, "left_semi")
        .select(key, "piece", F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys")),
        "track-long")
    kind = dict(long_.dtypes)[key]
    xy = "struct<x:double,y:double>"
    tabled = stage(
        long_.mapInArrow(
            _tabulator(key, meters),
            f"`{key}` {kind}, piece bigint, ends array<int>, hull array<{xy}>, tokens array<struct<at:int,x:double,y:double>>"),
        "track-tables")
    tokens = tabled.select(key, "piece", F.inline("tokens"))

    leaving = first_later_far(tokens, tabled.select(key, "piece", "hull"), key, meters, fan)
    asked = leaving.groupBy(key, F.col("far").alias("piece")).agg(
        F.collect_list(F.struct(F.col("piece").alias("from_piece"), F.col("at").alias("from_at"), "x", "y")).alias("asked"))
    landed = stage(
        long_.join(tabled.select(key, "piece", "ends"), [key, "piece"]).join(asked, [key, "piece"]).mapInArrow(
            _lander(key, meters), f"`{key}` {kind}, piece bigint, from_piece bigint, from_at int, x double, y double, to_at int"),
        "track-jumps")

    def name(piece: str, at: str):
        return F.col(piece) * (1 << 31) + F.col(at)

    jumps = stage(landed.select(key, name("from_piece", "from_at").alias("a"), name("piece", "to_at").alias("b")), "track-jumps")
    doubled, count = [jumps], tabled.agg(F.max("piece")).first()[0]
    for _ in range(count.bit_length() - 1):
        longer = doubled[-1].alias("s").join(doubled[-1].alias("t"), (F.col(f"s.{key}") == F.col(f"t.{key}")) & (F.col("s.b") == F.col("t.a")))
        doubled.append(stage(longer.select(f"s.{key}", "s.a", "t.b"), "track-jumps"))
    reached = tabled.where("piece = 0").select(key, F.col("ends")[0].cast("long").alias("a"))
    for table in reversed(doubled):
        reached = stage(reached.union(reached.join(table, [key, "a"]).select(key, F.col("b").alias("a"))), "track-reached")
    made = landed.withColumn("a", name("from_piece", "from_at")).join(reached, [key, "a"], "left_semi")
    return made.select(key, "piece", "x", "y")


def first_later_far(tokens: DataFrame, pieces: DataFrame, key: str, meters: float, fan: int = FAN) -> DataFrame:
    """``tokens(key, piece, at, x, y)`` with ``far``: the first later piece with a point ``meters`` away; none without.

    ``pieces(key, piece, hull)``.  Pieces are cut into blocks of ``fan``, blocks into blocks of ``fan``
    blocks; a block has the hulls of its children.  A token climbs until a later sibling holds a corner
    far enough and descends to the first such piece; each step is an equi-join.
    """
    highest = pieces.agg(F.max("piece")).first()[0] or 0
    levels, child = [], pieces.select(key, F.col("piece").alias("i"), "hull")
    while not levels or highest:
        level = stage(
            child.groupBy(F.col(key).alias("__key"), F.expr(f"i div {fan}").alias("__block"))
            .agg(F.array_sort(F.collect_list(F.struct("i", "hull"))).alias("__kids")), "track-hulls")
        levels.append(level)
        child = level.mapInArrow(_hull_of_kids(), f"__key {dict(level.dtypes)['__key']}, __block bigint, hull {dict(pieces.dtypes)['hull']}").select(
            F.col("__key").alias(key), F.col("__block").alias("i"), "hull")
        highest //= fan

    def far(corner):
        dx, dy = corner["x"] - F.col("x"), corner["y"] - F.col("y")
        return F.sqrt(dx * dx + dy * dy) >= meters

    def seek(rows: DataFrame, number: int, block, after) -> DataFrame:
        joined = rows.join(levels[number], (F.col(key) == F.col("__key")) & (block == F.col("__block")))
        fits = F.filter("__kids", lambda kid: (F.lit(True) if after is None else kid["i"] > after) & F.exists(kid["hull"], far))
        return joined.withColumn("__i", F.try_element_at(fits, F.lit(1))["i"]).drop("__key", "__block", "__kids")

    columns = tokens.columns
    found, open_ = [], tokens
    for number in range(len(levels)):
        up = stage(seek(open_, number, F.expr(f"piece div {fan ** (number + 1)}"), F.expr(f"piece div {fan ** number}")), "track-tokens")
        found.append(up.where(F.col("__i").isNotNull()))
        open_ = up.where(F.col("__i").isNull()).select(*columns)
    here = None
    for number in range(len(levels) - 1, 0, -1):
        known = found[number] if here is None else here.unionByName(found[number])
        here = seek(known.withColumnRenamed("__i", "__in"), number - 1, F.col("__in"), None).drop("__in")
    near = found[0] if here is None else here.unionByName(found[0])
    return near.select(*columns, F.col("__i").alias("far"))


# The functions below run in Python workers.  They are closed in themselves, so that a worker needs no copy of this package.


def _tabulator(key: str, meters: float):
    """Arrow batches of (key, piece, xs, ys) to (key, piece, ends, hull, tokens)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def corners(x, y):
            """The convex hull, lower and upper chain, of the points with numbers."""
            real = ~(np.isnan(x) | np.isnan(y))
            spots = np.unique(np.column_stack([x[real], y[real]]), axis=0).tolist()
            if len(spots) < 3:
                return spots
            chains = []
            for side in (spots, spots[::-1]):
                chain = []
                for p in side:
                    while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                              - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) < 0:
                        chain.pop()
                    chain.append(p)
                chains += chain[:-1]
            return chains

        for batch in batches:
            keys, out = batch.column(key), []
            for row in range(batch.num_rows):
                x, y = (np.array(batch.column(c)[row].values.to_numpy(zero_copy_only=False), float) for c in ("xs", "ys"))
                n = len(x)
                follows = np.full(n, n)  # the next kept point after each point of the piece
                left = np.arange(n - 1)
                gap = 1
                blank = np.isnan(x)  # after a point without a place the next one is kept
                while len(left):
                    dx, dy = x[left + gap] - x[left], y[left + gap] - y[left]
                    hit = (np.sqrt(dx * dx + dy * dy) >= meters) | blank[left]
                    follows[left[hit]] = left[hit] + gap
                    gap += 1
                    left = left[~hit]
                    left = left[left + gap < n]
                ends = np.arange(n)
                for i in range(n - 1, -1, -1):
                    if follows[i] < n:
                        ends[i] = ends[follows[i]]
                tokens = [{"at": int(t), "x": float(x[t]), "y": float(y[t])} for t in np.unique(ends)]
                out.append((ends.astype(np.int32), [{"x": a, "y": b} for a, b in corners(x, y)], tokens))
            xy = [("x", pa.float64()), ("y", pa.float64())]
            yield pa.RecordBatch.from_arrays([
                keys, batch.column("piece"), pa.array([o[0] for o in out], pa.list_(pa.int32())),
                pa.array([o[1] for o in out], pa.list_(pa.struct(xy))),
                pa.array([o[2] for o in out], pa.list_(pa.struct([("at", pa.int32()), *xy]))),
            ], [key, "piece", "ends", "hull", "tokens"])

    return run


def _hull_of_kids():
    """Arrow batches of (__key, __block, __kids) to (__key, __block, hull): corners that no direction needs are dropped."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hulls = []
            for kids in batch.column("__kids").to_pylist():
                spots = sorted({(c["x"], c["y"]) for kid in kids for c in kid["hull"]})
                chains = []
                for side in (spots, spots[::-1]):
                    chain = []
                    for p in side:
                        while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                                  - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) < 0:
                            chain.pop()
                        chain.append(p)
                    chains += chain[:-1] if len(spots) > 1 else chain
                hulls.append([{"x": a, "y": b} for a, b in chains])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), batch.column("__block"),
                 pa.array(hulls, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], ["__key", "__block", "hull"])

    return run


def _lander(key: str, meters: float):
    """Arrow batches of (key, piece, xs, ys, ends, asked) to one row for each point asked: where it lands, and the end from there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = {c: [] for c in ("row", "from_piece", "from_at", "x", "y", "to_at")}
            for row in range(batch.num_rows):
                x, y = (np.array(batch.column(c)[row].values.to_numpy(zero_copy_only=False), float) for c in ("xs", "ys"))
                ends = batch.column("ends")[row].values.to_numpy()
                for token in batch.column("asked")[row].as_py():
                    dx, dy = x - token["x"], y - token["y"]
                    landing = int(np.argmax((np.sqrt(dx * dx + dy * dy) >= meters)))
                    rows["row"].append(row)
                    for c in ("from_piece", "from_at", "x", "y"):
                        rows[c].append(token[c])
                    rows["to_at"].append(int(ends[landing]))
            at = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(at), batch.column("piece").take(at), pa.array(rows["from_piece"], pa.int64()),
                pa.array(rows["from_at"], pa.int32()), pa.array(rows["x"], pa.float64()), pa.array(rows["y"], pa.float64()),
                pa.array(rows["to_at"], pa.int32()),
            ], [key, "piece", "from_piece", "from_at", "x", "y", "to_at"])

    return run


def verify_challenges(emotes: DataFrame, challenges: DataFrame, links: DataFrame) -> DataFrame:
    """Replay emotes against pending challenges; the first completed one wins its label.

    ``emotes(event_id, gamertag, emote, occurred_at)``.  A challenge advances on the next token
    of its sequence, issued < t < expires, event id above its last match; other emotes are
    ignored.  When a challenge completes, the link becomes verified and its pending rivals are
    cancelled - unless the label already belongs to a verified link, which cancels this one.
    Columns: challenge_id, link_id, progress_index, last_matched_event_id, completed_at, status.
    """
    pending = (
        challenges.where(F.col("completed_at").isNull())
        .select(
            F.col("id").alias("challenge_id"), F.col("gamertag_link_id").alias("link_id"), "sequence",
            "progress_index", "last_matched_event_id", "issued_at", "expires_at",
        )
        .join(
            links.where(F.col("status") == "pending").select(
                F.col("id").alias("link_id"), F.lower("gamertag").alias("label")
            ),
            "link_id",
        )
    )
    tokens = emotes.select(
        F.lower("gamertag").alias("label"), "emote", "event_id", "occurred_at"
    )
    usable = stage(
        pending.join(tokens, "label").where(
            (F.col("issued_at") < F.col("occurred_at"))
            & (F.col("expires_at") > F.col("occurred_at"))
            & (F.col("event_id") > F.coalesce("last_matched_event_id", F.lit(0)))
            & F.array_contains("sequence", F.col("emote"))
        ).select("challenge_id", "emote", "event_id", "occurred_at"),
        "challenge-emotes",
    )
    longest = challenges.agg(F.max(F.size("sequence"))).first()[0] or 0
    # matched: array of (event_id, occurred_at), one per step taken in this replay.
    state = pending.withColumn(
        "matched", F.array().cast("array<struct<event_id:bigint,occurred_at:timestamp>>")
    )
    for _ in range(longest):
        state = stage(state, "challenge-state")
        place = F.col("progress_index") + F.size("matched")
        want = state.select(
            "challenge_id",
            F.try_element_at("sequence", (place + 1).cast("int")).alias("emote"),
            F.coalesce(F.try_element_at("matched", F.lit(-1))["event_id"], F.lit(0)).alias("after"),
        ).where(F.col("emote").isNotNull())
        step = (
            usable.join(want, ["challenge_id", "emote"])
            .where(F.col("event_id") > F.col("after"))
            .groupBy("challenge_id").agg(F.min(F.struct("event_id", "occurred_at")).alias("hit"))
        )
        state = (
            state.join(step, "challenge_id", "left")
            .withColumn(
                "matched",
                F.when(F.col("hit").isNotNull(), F.array_append("matched", F.col("hit")))
                .otherwise(F.col("matched")),
            )
            .drop("hit")
        )
    state = stage(state, "challenge-state")

    last = F.try_element_at("matched", F.lit(-1))
    complete = F.col("progress_index") + F.size("matched") == F.size("sequence")
    finished = state.where(complete & (F.size("matched") > 0)).select(
        "label", "link_id", last["event_id"].alias("event_id")
    )
    owned = links.where(F.col("status") == "verified").select(F.lower("gamertag").alias("label")).distinct()
    winners = first_by(
        finished.join(owned, "label", "left_anti"), ["label"], [F.col("event_id"), F.col("link_id")]
    ).select("label", F.col("link_id").alias("winner"), F.col("event_id").alias("won_at"))

    rows = state.join(winners, "label", "left").join(
        owned.withColumn("owned", F.lit(True)), "label", "left"
    )
    # After a win the rivals are no longer pending, so their later matches do not count.
    counted = F.filter(
        "matched", lambda m: F.col("won_at").isNull() | (m["event_id"] <= F.col("won_at"))
    )
    rows = rows.withColumn("matched", counted)
    last = F.try_element_at("matched", F.lit(-1))
    done = (F.col("progress_index") + F.size("matched") == F.size("sequence")) & (F.size("matched") > 0)
    status = (
        F.when(F.col("winner") == F.col("link_id"), "verified")
        .when(F.col("winner").isNotNull(), "cancelled")
        .when(F.coalesce("owned", F.lit(False)) & done, "cancelled")
        .otherwise("pending")
    )
    return rows.select(
        "challenge_id", "link_id", "label",
        (F.col("progress_index") + F.size("matched")).alias("progress_index"),
        F.coalesce(last["event_id"], F.col("last_matched_event_id")).alias("last_matched_event_id"),
        F.when(done, last["occurred_at"]).alias("completed_at"),
        status.alias("status"),
    )
