"""Log reading, line extraction, timestamps, backfills, idempotent sinks."""

import json
from datetime import datetime, timedelta

from helpers import collect, table
from pyspark.sql import functions as F

from lifelog.operators import ordered
from lifelog.schemas import EVENTS
from lifelog.sources.backfill import backfill_unconscious, rederive_causes, rederive_vitals
from lifelog.sources.extract import assign_timestamps, events_from_lines, parse_lines
from lifelog.sources.logs import (
    broken_files,
    clock_offsets,
    files_to_load,
    incremental_lines,
    log_files,
    next_cursor,
    oldest_first,
    read_log_lines,
    stream_log_lines,
    sweep_logs,
)
from lifelog.sources.payload import validate_events
from lifelog.sources.tables import (
    append_new,
    backfill_account_ids,
    canonicalize_labels,
    events_after,
    label_collisions,
    load_tables,
    save_tables,
)

POS = "pos=<100.0, 200.5, 3.0>"


def parsed(spark, *lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_index int, text string")
    rows = parse_lines(df).orderBy("line_index", "sub_index").collect()
    return [(r.line_index, r.sub_index, r.type, json.loads(r.payload)) for r in rows]


def one(spark, line):
    return [(t, p) for _, _, t, p in parsed(spark, line)]


def test_boot_and_roster_short_circuit(spark):
    assert one(spark, "AdminLog started on 2026-01-02 at 22:10:00") == [
        ("server.rebooted", {"localDateTime": "2026-01-02 22:10:00"})
    ]
    assert one(spark, "22:00:00 | ##### PlayerList log: 12 players") == [("roster.snapshot", {"count": 12})]


def test_presence_lines(spark):
    who = {"gamertag": "Tester One", "dayzId": "AAA="}
    assert one(spark, '1 | Player "Tester One"(id=AAA=) is connecting') == [("player.connecting", who)]
    got = one(spark, f'1 | Player "Tester One" (id=AAA= {POS}) is connected')
    assert got == [("player.connected", who), ("player.position", {"gamertag": "Tester One", "x": 100.0, "y": 200.5})]
    assert one(spark, '1 | Player "Tester One"(id=AAA=) has been disconnected') == [("player.disconnected", who)]


def test_pvp_death_with_weapon_and_distance(spark):
    line = f'1 | Player "V" (DEAD) (id=A {POS}) killed by Player "K" (id=B {POS}) with SK 59/66 from 12.5.1 meters'
    (kind, p), position = one(spark, line)
    assert kind == "player.died" and position[0] == "player.position"
    assert (p["victim"], p["killer"], p["weapon"], p["distance"], p["cause"]) == ("V", "K", "SK 59/66", 12.5, "pvp")
    melee = one(spark, f'1 | Player "V" (DEAD) (id=A {POS}) killed by Player "K" (id=B {POS}) with Fists')[0][1]
    assert melee["weapon"] == "Fists" and melee["distance"] is None


def test_other_deaths(spark):
    dead = f'1 | Player "V" (DEAD) (id=A {POS})'
    cases = {
        " bled out": "bled_out", " drowned": "drowned", " committed suicide": "suicide",
        " killed by Animal_CanisLupus_Grey": "wolf", " killed by Animal_UrsusArctos": "bear",
        " killed by Animal_CapraHircus": "animal", " killed by ZmbM_Hermit": "infected",
        " killed by FallDamage": "fall", " killed by Hatchback_02_Blue": "vehicle",
        " killed by Barbed_Thing": "environment", " died. Stats> Water: 10.5 Energy: 0 Bleed sources: 2": "died",
    }
    got = parsed(spark, *[dead + tail for tail in cases])
    deaths = [p for _, _, t, p in got if t == "player.died"]
    assert [d["cause"] for d in deaths] == list(cases.values())
    assert deaths[3]["deathEntity"] == "Animal_CanisLupus_Grey" and deaths[0]["deathEntity"] is None
    assert (deaths[-1]["water"], deaths[-1]["energy"], deaths[-1]["bleedSources"]) == (10.5, 0.0, 2)
    # A corpse in a player list is not a death, a hit on a corpse neither.
    assert [t for t, _ in one(spark, dead)] == ["player.position"]
    assert [t for t, _ in one(spark, dead + " hit by Infected into Head(0) for 3 damage")] == ["player.hit"]


def test_hits(spark):
    head = f'1 | Player "V" (id=A {POS})[HP: 80.5] hit by '
    player = one(spark, head + f'Player "K" (id=B {POS}) into Torso(3) for 4.5 damage (Melee)')
    assert player == [("player.hit", {
        "victim": "V", "victimHp": 80.5, "attackerType": "player", "attackerGamertag": "K", "attackerLabel": None,
        "damage": 4.5, "bodyPart": "Torso", "x": 100.0, "y": 200.5})]
    infected = one(spark, head + "Infected into LeftLeg(1) for 2 damage")[0][1]
    assert (infected["attackerType"], infected["attackerLabel"]) == ("infected", "Infected")
    fall = one(spark, head + "FallDamageHealth")[0][1]
    assert (fall["attackerType"], fall["attackerLabel"], fall["bodyPart"]) == ("environment", "FallDamageHealth", None)


def test_builds_emotes_teleports(spark):
    build = one(spark, f'1 | Player "B" (id=A {POS})Built base on Fence<Fence_1> with Shovel ')[0]
    assert build == ("build.built", {"gamertag": "B", "action": "built", "object": "base on Fence",
                                     "className": "Fence_1", "tool": "Shovel", "x": 100.0, "y": 200.5})
    assert one(spark, f'1 | Player "B" (id=A {POS}) placed Tent')[0][1]["className"] is None
    emote = one(spark, f'1 | Player "B" (id=A {POS}) performed EmoteClap with Rag')[0]
    assert emote[0] == "emote.performed" and (emote[1]["emote"], emote[1]["item"]) == ("EmoteClap", "Rag")
    tele = one(spark, '1 | Player "B" (id=A) was teleported from: <1.5, 2, 3> to: <4, 5, -6.5>. Reason: Bug ')[0]
    assert tele == ("player.teleported", {"gamertag": "B", "from": [1.5, 2.0, 3.0], "to": [4.0, 5.0, -6.5],
                                          "reason": "Bug"})


def test_positions_bounds_and_off_map(spark):
    line = '1 | Player "B" (id=A pos=<{}, 5.0, 1.0>)'
    got = parsed(spark, *[line.format(x) for x in ("-1000.0", "16360.0", "16360.5", "-1.2e+12", "3e5")])
    assert [i for i, _, t, _ in got if t == "player.position"] == [0, 1]


def test_knockout_stays_after_position(spark):
    got = parsed(
        spark, f'1 | Player "B" (id=A {POS}) is unconscious',
        f'1 | Player "B" (id=A {POS}) is disconnecting while being unconscious',
        f'1 | Player "B" (id=A {POS}) regained consciousness', f'1 | Player "B" (DEAD) (id=A {POS}) is unconscious',
    )
    assert [(i, s, t) for i, s, t, _ in got] == [
        (0, 0, "player.position"), (0, 1, "player.unconscious"), (1, 0, "player.position"),
        (1, 1, "player.unconscious"), (2, 0, "player.position"), (3, 0, "player.position"),
    ]
    assert [p["disconnecting"] for _, _, t, p in got if t == "player.unconscious"] == [False, True]


def stamped(spark, lines, start="2026-03-01 00:00:00"):
    df = spark.createDataFrame(
        [("f", i, t) for i, t in enumerate(lines)], "file string, line_index int, text string"
    ).withColumn("started_at", F.lit(start).cast("timestamp"))
    return [r.occurred_at for r in assign_timestamps(df).orderBy("line_index").collect()]


def test_timestamps_header_rollover_fallback(spark, monkeypatch):
    lines = ["AdminLog started on 2026-01-02 at 22:10:00", "22:10:05 | a", "noise", "00:00:01 | b", "13:00:00 | c",
             "12:59:59 | d", "00:59:59 | e", "AdminLog started on 2026-02-01 at 23:00:00", "01:00:00 | f"]
    want = [None, datetime(2026, 1, 2, 22, 10, 5), None, datetime(2026, 1, 3, 0, 0, 1), datetime(2026, 1, 3, 13),
            datetime(2026, 1, 3, 12, 59, 59), datetime(2026, 1, 3, 0, 59, 59), None, datetime(2026, 2, 2, 1)]
    # A drop of exactly 12 h does not roll, one second more does.
    assert stamped(spark, lines) == want
    assert stamped(spark, ["23:00:00 | a", "11:00:00 | b", "23:00:01 | c", "11:00:00 | d"]) == [
        datetime(2026, 3, 1, 23), datetime(2026, 3, 1, 11), datetime(2026, 3, 1, 23, 0, 1), datetime(2026, 3, 2, 11)]
    monkeypatch.setattr(ordered.event_slice, "__defaults__", ("event_id", 2))
    assert stamped(spark, lines) == want


def write_logs(root):
    names = {"server_id=1/DayZServer_X1_x64_2026-01-02_22-10-00.ADM":
             "AdminLog started on 2026-01-02 at 22:10:00\r\n\r\n22:10:05 | Player \"A\"(id=X) is connecting\n"
             "22:11:00 | Player \"A\"(id=X) has been disconnected\r\n",
             "server_id=1/DayZServer_X1_x64_2026-01-03_00-10-00.ADM": "00:10:01 | one\n00:10:02 | two",
             "server_id=2/DayZServer_X1_x64_2026-01-01_00-00-00.ADM": "00:00:01 | x\n",
             "server_id=2/ignored.RPT": "00:00:01 | y\n"}
    for name, text in names.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())


def test_files_lines_and_incremental_load(spark, tmp_path):
    write_logs(tmp_path)
    files = log_files(spark, str(tmp_path))
    assert [(r.server_id, r.started_at) for r in oldest_first(files).collect()] == [
        (2, datetime(2026, 1, 1)), (1, datetime(2026, 1, 2, 22, 10)), (1, datetime(2026, 1, 3, 0, 10))]
    lines = read_log_lines(spark, str(tmp_path))
    want = [(1, 0, "AdminLog started on 2026-01-02 at 22:10:00"), (1, 2, '22:10:05 | Player "A"(id=X) is connecting'),
            (1, 3, '22:11:00 | Player "A"(id=X) has been disconnected'), (1, 0, "00:10:01 | one"),
            (1, 1, "00:10:02 | two"), (2, 0, "00:00:01 | x")]
    assert collect(lines, "server_id", "line_index", "text") == sorted(want, key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40)
    try:
        assert collect(read_log_lines(spark, str(tmp_path)), "server_id", "line_index", "text") == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    streamed = stream_log_lines(spark, str(tmp_path), 1)
    q = streamed.writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert collect(spark.table("lines"), "server_id", "line_index", "text") == sorted(want, key=repr)

    # Server 1 has one closed file waiting: budget 0 holds back the live file too.
    cursor = spark.createDataFrame([], "file string, last_processed_line int, is_complete boolean")
    held = files_to_load(files, cursor, 0)
    assert collect(held, "server_id") == [(2,)]
    batch = files_to_load(files, cursor, 1)
    assert batch.count() == 3
    after = next_cursor(lines, batch)
    assert sorted((r.last_processed_line, r.is_complete) for r in after.collect()) == [(1, False), (2, False), (4, True)]
    assert incremental_lines(lines, after).count() == 0
    assert files_to_load(files, after, 0).count() == 2
    events = events_from_lines(lines.where("server_id = 1 and started_at < '2026-01-03'"))
    assert collect(events, "line_index", "type", "occurred_at") == [
        (0, "server.rebooted", datetime(2026, 1, 2, 22, 10)),
        (2, "player.connecting", datetime(2026, 1, 2, 22, 10, 5)),
        (3, "player.disconnected", datetime(2026, 1, 2, 22, 11))]


def test_clock_offsets(spark):
    t = datetime(2026, 1, 1)
    files = spark.createDataFrame(
        [(1, t, t + timedelta(hours=5, minutes=3)), (1, t, t + timedelta(hours=5, minutes=50)),
         (2, t, datetime(1970, 1, 1)), (3, None, t)],
        "server_id int, started_at timestamp, modified_at timestamp")
    servers = table(spark, "servers", [dict(id=i, clock_offset_ms=o) for i, o in ((1, 7), (2, 99), (3, None))])
    assert collect(clock_offsets(files, servers), "server_id", "clock_offset_ms") == [(1, 18_000_000), (2, 99), (3, 0)]


def test_payload_quarantine(spark):
    rows = [("player.connected", '{"gamertag": "A", "dayzId": "x"}', True), ("player.connected", "{}", False),
            ("player.died", '{"victim": "A", "cause": "died"}', False),
            ("player.died", '{"victim": "A", "cause": "died", "killer": null, "weapon": null, "distance": null}', True),
            ("player.position", '{"gamertag": "A", "x": 1, "y": "bad"}', False),
            ("player.position", '{"gamertag": "A", "x": 1, "y": 2.5}', True),
            ("emote.performed", '{"anything": 1}', True), ("emote.performed", "not json", False),
            ("build.placed", '{"gamertag": "A", "action": "placed"}', False)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(rows)], "event_id long, type string, payload string")
    valid, bad = validate_events(df)
    assert [r.event_id for r in valid.orderBy("event_id").collect()] == [i for i, r in enumerate(rows) if r[2]]
    assert bad.count() == sum(not r[2] for r in rows)


def test_sinks_and_table_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (2, 1, "c")], "k int, v int, t string")
    stored = spark.createDataFrame([(2, 1)], "k int, v int")
    assert collect(append_new(df, stored, ["k", "v"], "t"), "k", "t") == [(1, "a")]
    save_tables({"x": df}, str(tmp_path), ["k"])
    save_tables({"x": df}, str(tmp_path), ["k"])
    assert load_tables(spark, str(tmp_path), ["x"])["x"].count() == 3
    events = spark.createDataFrame([(i,) for i in range(10)], "event_id long")
    assert [r.event_id for r in events_after(events, 3, 2).collect()] == [4, 5]


def test_backfills(spark):
    t = datetime(2026, 1, 1)
    dead = f'1 | Player "V" (DEAD) (id=A {POS})'
    raw = spark.createDataFrame(
        [(1, 1, 1, 0, t, f'1 | Player "B" (id=A {POS}) is unconscious'),
         (2, 1, 1, 1, None, f'1 | Player "B" (id=A {POS}) is unconscious'),
         (3, 1, 1, 2, t, dead + " killed by Animal_CanisLupus_Grey"),
         (4, 1, 1, 3, t, dead + " killed by Strange_Object"),
         (5, 1, 1, 4, t, dead + " bled out. Stats> Water: 1 Energy: 2 Bleed sources: 3")],
        "raw_line_id long, server_id int, file_id long, line_index int, occurred_at timestamp, text string")
    payload = lambda **k: json.dumps({"victim": "V", "cause": "died", "killer": None, "weapon": None,
                                      "distance": None, **k})
    events = spark.createDataFrame(
        [(9, 1, 1, 2, 0, "player.died", t, payload(cause="environment"), 3),
         (10, 1, 1, 3, 0, "player.died", t, payload(cause="environment", deathEntity="Strange_Object"), 4),
         (11, 1, 1, 4, 0, "player.died", t, payload(), 5),
         (12, 1, 1, 5, 0, "player.died", t, payload(energy=1.0), 5)], EVENTS)
    new = backfill_unconscious(raw, events)
    assert collect(new, "line_index", "sub_index", "type") == [(0, 1, "player.unconscious")]
    assert backfill_unconscious(raw, new).count() == 0
    patched, survey = rederive_causes(events, raw)
    got = {r.event_id: json.loads(r.payload) for r in patched.collect()}
    assert {k: (v["cause"], v["deathEntity"]) for k, v in got.items()} == {
        9: ("wolf", "Animal_CanisLupus_Grey"), 11: ("bled_out", None), 12: ("bled_out", None)}
    assert collect(survey, "entity", "deaths") == [("Strange_Object", 1)]
    vitals = {r.event_id: json.loads(r.payload) for r in rederive_vitals(events, raw).collect()}
    assert {k: (v["cause"], v["water"], v["energy"], v["bleedSources"]) for k, v in vitals.items()} == {
        11: ("bled_out", 1.0, 2.0, 3)}


def test_label_repair(spark):
    players = table(spark, "players", [dict(id=1, gamertag="Sasha", dayz_id="h", last_seen_at=datetime(2026, 1, 1)),
                                       dict(id=2, gamertag="Bob")])
    links = table(spark, "gamertag_links", [
        dict(id=1, user_id="u", gamertag="sasha", status="verified"), dict(id=2, user_id="u", gamertag="SASHA", status="pending"),
        dict(id=3, user_id="w", gamertag="Bob", status="pending")])
    assert collect(canonicalize_labels(links, players), "id", "canonical") == [(1, "Sasha"), (2, "Sasha")]
    assert collect(label_collisions(players, links), "source", "label", "copies") == [("links of one user", "sasha", 2)]
    bans = table(spark, "bans", [dict(id=1, gamertag="SASHA"), dict(id=2, gamertag="Bob", dayz_id="old")])
    assert collect(backfill_account_ids(bans, players), "id", "dayz_id") == [(1, "h"), (2, "old")]


def test_a_bad_file_costs_its_own_lines_only(spark, tmp_path):
    good, bad, gone, empty = (tmp_path / f"server_id={n}" / f"DayZServer_X1_x64_2024-01-0{n}_00-00-00.ADM" for n in (1, 2, 3, 4))
    for file, data in ((good, b"one\n\nthree\n"), (bad, b"fine\n\xff\xfe broken\n"), (gone, b"soon gone\n"), (empty, b"")):
        file.parent.mkdir()
        file.write_bytes(data)
    files = log_files(spark, str(tmp_path)).select("server_id", "file", "length").cache()
    assert files.count() == 3  # an empty file has nothing to give and is not listed
    lines = read_log_lines(spark, str(tmp_path), isolate=True)
    gone.unlink()  # after the listing, before the lines are read
    assert sorted((r.server_id, r.line_index, r.text) for r in lines.collect() if r.server_id != 2) == [(1, 0, "one"), (1, 2, "three")]
    assert sorted((r.server_id, r.reason) for r in broken_files(files, lines).collect()) == [(2, "undecodable"), (3, "unreadable")]
    files.unpersist()
    swept, broken = sweep_logs(spark, str(tmp_path))
    assert sorted((r.server_id, r.text) for r in swept.collect()) == [(1, "one"), (1, "three")]
    assert [(r.server_id, r.reason) for r in broken.collect()] == [(2, "undecodable")]
