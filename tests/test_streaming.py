"""Streaming results equal the batch results on the same events."""

import json
import os
import random

import pytest
from helpers import at, collect, connect, table
from test_fold import random_stream

from lifelog.operators.tracks import verify_challenges
from lifelog.operators.windows import encounters
from lifelog.projections import PROJECTION_TABLES, rebuild
from lifelog.schemas import EVENTS
from lifelog.sources.payload import typed_events
from lifelog.streaming import (
    append_once,
    dedupe_stream,
    read_projection,
    run_projector,
    stream_encounters,
    stream_presence,
    stream_verify,
)
from lifelog.streaming.projector import FIRST, _Projector
from lifelog.streaming.versions import Versions


def stream_of(spark, tmp_path, batches, schema):
    """File stream with one JSON file, hence one micro-batch, per list of rows."""
    for i, rows in enumerate(batches):
        with open(tmp_path / f"part-{i}.json", "w") as f:
            for r in rows:
                f.write(json.dumps(r, default=lambda v: v.strftime("%Y-%m-%dT%H:%M:%S.%fZ")) + "\n")
        os.utime(tmp_path / f"part-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
        availableNow=True
    ).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


NAMES = [p.strip().split(" ")[0] for p in EVENTS.split(", ")]


def log_rows(stream):
    return [dict(zip(NAMES, (i + 1, s, 1, i, 0, t, at(sec), json.dumps(p), None))) for i, (s, t, sec, p) in enumerate(stream)]


def assert_rebuilt(spark, out, rows):
    batch = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], EVENTS)
    want = rebuild(typed_events(batch))
    for name in PROJECTION_TABLES:
        columns = want[name].columns
        got = read_projection(spark, out, name)
        assert ([] if got is None else collect(got, *columns)) == collect(want[name], *columns), name


def test_projector_equals_rebuild(spark, tmp_path):
    rows = log_rows(random_stream(4, n=120))
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    broken = [{**rows[0], "event_id": 900 + i, "line_index": 900 + i, "payload": bad} for i, bad in enumerate(("{", "[]", None))]
    events = stream_of(spark, src, [rows[:70] + broken[:1], rows[70:] + broken[1:]], EVENTS)
    run_projector(events, out, str(tmp_path / "cp"), label_buckets=4).awaitTermination(300)
    assert_rebuilt(spark, out, rows)
    assert collect(read_projection(spark, out, "quarantine"), "event_id", "payload") == [(900, "{"), (901, "[]"), (902, None)]


def everything(df):
    return [] if df is None else collect(df, *df.columns)


def project(spark, out, batches, gather_every=50, start=0):
    projector = _Projector(out, 4, gather_every)
    for number, rows in enumerate(batches):
        projector(spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], EVENTS), start + number)
    return projector


def test_batches_in_order_read_no_history(spark, tmp_path, monkeypatch):
    rows = log_rows(random_stream(3, n=120, recycle=True))
    read = []
    real = Versions.rows
    monkeypatch.setattr(Versions, "rows", lambda self, spark, name, at: read.append(name) or real(self, spark, name, at))
    project(spark, str(tmp_path), [rows[i:i + 40] for i in range(0, len(rows), 40)], gather_every=1)
    # Facts are looked up by natural key on the days of the batch; lives, sessions, kills and the log are never read.
    assert set(read) <= {"persons", "standing", "player_gamertags", *FIRST}
    assert_rebuilt(spark, str(tmp_path), rows)


def test_every_order_of_arrival_gives_the_tables_of_a_rebuild(spark, tmp_path):
    rows = log_rows(random_stream(5, n=90, recycle=True))
    own = random.Random(5)
    late = sorted(own.sample(range(20, 60), 12))
    first = [r for i, r in enumerate(rows[:60]) if i not in late]
    project(spark, str(tmp_path), [first, [rows[i] for i in late[6:]] + rows[60:75], [rows[i] for i in late[:6]] + rows[10:20], rows[75:]])
    assert_rebuilt(spark, str(tmp_path), rows)


def test_a_late_connect_takes_facts_back(spark, tmp_path):
    story = [(1, "player.connected", 0, connect("Tag", "idA")), (1, "player.connected", 5, connect("Tag", "idB")),
             (1, "player.position", 10, {"gamertag": "tag", "x": 1.0, "y": 2.0})]
    rows = log_rows(story)
    project(spark, str(tmp_path), [[rows[0], rows[2]]])
    assert collect(read_projection(spark, str(tmp_path), "positions"), "event_id", "player_id") == [(3, 1)]
    project(spark, str(tmp_path), [[rows[1]]], start=1)
    assert collect(read_projection(spark, str(tmp_path), "positions"), "event_id", "player_id") == [(3, 2)]
    stored = Versions(str(tmp_path)).rows(spark, "positions", Versions(str(tmp_path)).pointer(spark))
    assert collect(stored, "version", "event_id", "player_id") == [(0, 3, 1), (1, 3, 2)]
    # A connect with an id below the first one of its account: the person and its rows get that id.
    early = {**rows[1], "event_id": 0, "line_index": 77, "payload": json.dumps(connect("Tag", "idA"))}
    project(spark, str(tmp_path), [[early]], start=2)
    assert sorted(r.id for r in read_projection(spark, str(tmp_path), "players").collect()) == [0, 2]


def test_readers_see_whole_versions_only(spark, tmp_path, monkeypatch):
    rows = log_rows(random_stream(6, n=60))
    out = str(tmp_path)
    project(spark, out, [rows[:30]])
    before = {n: everything(read_projection(spark, out, n)) for n in PROJECTION_TABLES}
    seen = []
    real = Versions.write

    def write(self, df, name, version, partition=()):
        real(self, df, name, version, partition)
        if name in ("lives", "kills"):  # half of the version is written
            seen.append({n: everything(read_projection(spark, out, n)) for n in PROJECTION_TABLES} == before)
        if name == "kills" and len(seen) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(Versions, "write", write)
    with pytest.raises(RuntimeError):
        project(spark, out, [rows[30:]], start=1)
    assert seen == [True, True]
    assert {n: everything(read_projection(spark, out, n)) for n in PROJECTION_TABLES} == before
    monkeypatch.setattr(Versions, "write", real)
    old = Versions(out).pointer(spark)
    projector = project(spark, out, [rows[30:]], start=1)  # written again, and a replay is left out
    projector(spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows[30:]], EVENTS), 1)
    assert Versions(out).pointer(spark).version == 1
    assert_rebuilt(spark, out, rows)
    # A reader that took the older pointer goes on with that version.
    assert {n: everything(read_projection(spark, out, n, old)) for n in PROJECTION_TABLES} == before


HITS = "event_id long, life_id long, victim_hp double, occurred_at timestamp"


def test_encounters_gap_and_batch_equality(spark, tmp_path):
    seconds = [0, 120, 241, 300, 2000]
    rows = [dict(event_id=i, life_id=1, victim_hp=90.0 - i, occurred_at=at(s)) for i, s in enumerate(seconds)]
    late = [dict(event_id=99, life_id=2, victim_hp=1.0, occurred_at=at(90_000))]
    spans = stream_encounters(stream_of(spark, tmp_path, [rows, late], HITS), ["life_id"])
    got = collect(run(spans, "spans"), "life_id", "started_at", "last_at", "hits", "hp_low")
    assert got == [
        (1, at(0), at(120), 2, 89.0), (1, at(2000), at(2000), 1, 86.0), (1, at(241), at(300), 2, 87.0)
    ]
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], HITS)
    numbered = encounters(batch, ["life_id"]).groupBy("encounter").count()
    assert sorted(r["count"] for r in numbered.collect()) == [1, 2, 2]


def test_presence_expires_after_bound(spark, tmp_path):
    schema = "server_id int, player_id long, type string, occurred_at timestamp"
    rows = [dict(server_id=1, player_id=7, type=t, occurred_at=at(s)) for t, s in
            [("player.connected", 0), ("player.position", 900), ("player.hit", 1500), ("player.position", 3000)]]
    late = [dict(server_id=9, player_id=9, type="player.position", occurred_at=at(90_000))]
    spans = stream_presence(stream_of(spark, tmp_path, [rows, late], schema))
    assert collect(run(spans, "presence"), "player_id", "seen_from", "seen_to", "expires_at") == [
        (7, at(0), at(900), at(1800)), (7, at(3000), at(3000), at(3900)),
    ]


EMOTES = "event_id long, gamertag string, emote string, occurred_at timestamp"


def challenge_tables(spark):
    links = table(spark, "gamertag_links", [
        dict(id=1, user_id="a", gamertag="Tag", status="pending"),
        dict(id=2, user_id="b", gamertag="tag", status="pending"),
        dict(id=3, user_id="c", gamertag="Taken", status="pending"),
        dict(id=4, user_id="d", gamertag="taken", status="verified"),
        dict(id=5, user_id="e", gamertag="Slow", status="pending"),
    ])
    span = dict(progress_index=0, last_matched_event_id=0, issued_at=at(0), expires_at=at(1000))
    challenges = table(spark, "verification_challenges", [
        dict(id=1, gamertag_link_id=1, sequence=["A", "B", "C"], **span),
        dict(id=2, gamertag_link_id=2, sequence=["A", "C"], **span),
        dict(id=3, gamertag_link_id=3, sequence=["A"], **span),
        dict(id=5, gamertag_link_id=5, sequence=["A", "A"], **span),
    ])
    rows = [(10, "TAG", "A", 0), (11, "TAG", "A", 5), (12, "TAG", "X", 6), (13, "tag", "B", 7),
            (14, "tag", "C", 8), (15, "tag", "C", 9), (16, "Taken", "A", 10), (17, "slow", "A", 11),
            (18, "slow", "A", 1000)]
    return links, challenges, [dict(event_id=e, gamertag=g, emote=m, occurred_at=at(s)) for e, g, m, s in rows]


# Event 10 is not after the issue instant, event 18 not before expiry.
EXPECTED = [(1, 3, 14, "verified"), (2, 2, 14, "cancelled"), (3, 1, 16, "cancelled"), (5, 1, 17, "pending")]


def test_challenges_batch(spark):
    links, challenges, rows = challenge_tables(spark)
    emotes = spark.createDataFrame([tuple(r.values()) for r in rows], EMOTES)
    got = verify_challenges(emotes, challenges, links)
    assert collect(got, "challenge_id", "progress_index", "last_matched_event_id", "status") == EXPECTED


def test_challenges_stream(spark, tmp_path):
    links, challenges, rows = challenge_tables(spark)
    out = run(stream_verify(stream_of(spark, tmp_path, [rows[:4], rows[4:]], EMOTES), challenges, links), "verified")
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r.event_id, r.link_id)):
        last[r.challenge_id] = (r.challenge_id, r.progress_index, r.event_id, r.status)
    assert sorted(last.values()) == EXPECTED


def test_dedupe_within_watermark_and_over_history(spark, tmp_path):
    schema = "id long, occurred_at timestamp"
    src = tmp_path / "in"
    src.mkdir()
    rows = [dict(id=1, occurred_at=at(0)), dict(id=1, occurred_at=at(1)), dict(id=2, occurred_at=at(2))]
    events = stream_of(spark, src, [rows, rows], schema)
    assert sorted(r.id for r in run(dedupe_stream(events, ["id"]), "deduped").collect()) == [1, 2]
    sink = append_once(str(tmp_path / "log"), ["id"])
    for _ in range(2):
        sink(spark.createDataFrame([(1, at(0)), (1, at(0)), (3, at(0))], schema), 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 3]


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
