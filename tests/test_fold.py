"""Projections: boundary cases and a randomized comparison with a sequential fold."""

import random

import pytest
from helpers import SequentialFold, at, collect, connect, died, event_rows

from lifelog.operators import ordered
from lifelog.projections import rebuild
from lifelog.sources.payload import typed_events


def build(spark, events):
    return rebuild(typed_events(event_rows(spark, events)))


def random_stream(seed, n=160, recycle=False):
    rng = random.Random(seed)
    out, clock = [], 0
    people = ["A", "B", "C", "D"]
    names = {p: f"Tag{p}" for p in people}
    for _ in range(n):
        clock += rng.choice([1, 5, 60, 400])
        server, who = rng.choice([1, 2]), rng.choice(people)
        kind = rng.choices(
            ["connect", "disconnect", "die", "boot", "fix", "hit", "build"], [5, 3, 3, 1, 5, 2, 2]
        )[0]
        label = names[who]
        if rng.random() < 0.3:
            label = label.upper()
        if kind == "connect":
            if rng.random() < 0.25:
                pool = ["Shared", "Other", "TagA", "TagB"] if recycle else [f"Tag{who}", f"Alt{who}"]
                names[who] = rng.choice(pool)
            out.append((server, "player.connected", clock, connect(names[who], f"id{who}")))
        elif kind == "disconnect":
            out.append((server, "player.disconnected", clock, connect(label, f"id{who}")))
        elif kind == "die":
            cause = rng.choice(["pvp", "died", "wolf"])
            killer = rng.choice([*names.values(), "Nobody"]) if cause == "pvp" else None
            out.append((server, "player.died", clock, died(label, cause, killer)))
            if rng.random() < 0.4:
                out.append((server, "player.died", clock, died(label, "bled_out", energy=5.0)))
        elif kind == "boot":
            out.append((server, "server.rebooted", clock, {"localDateTime": "x"}))
        elif kind == "fix":
            out.append((server, "player.position", clock, {"gamertag": label, "x": 1.0 * clock, "y": 2.0}))
        elif kind == "hit":
            out.append((server, "player.hit", clock, {"victim": label, "attackerType": "infected"}))
        else:
            out.append((server, "build.placed", clock,
                        {"gamertag": label, "action": "placed", "object": f"o{clock}"}))
    return out


@pytest.mark.parametrize("seed,recycle,width", [
    (1, False, 4_000_000), (2, False, 7), (3, True, 4_000_000), (4, True, 5), (5, True, 50),
])
def test_window_form_equals_sequential_fold(spark, monkeypatch, seed, recycle, width):
    """Small slice widths force the cross-slice carry that hot keys use on a cluster."""
    monkeypatch.setattr(ordered.event_slice, "__defaults__", ("event_id", width))
    stream = random_stream(seed, recycle=recycle)
    truth = SequentialFold()
    for i, (server, kind, sec, payload) in enumerate(stream):
        truth.apply(i + 1, server, kind, at(sec), payload)
    got = build(spark, stream)

    def same(actual, expected):
        assert actual == sorted(expected, key=repr)

    same(collect(got["players"], "id", "gamertag", "dayz_id", "last_seen_at"),
         [(p["id"], p["label"], h, p["seen"]) for h, p in truth.people.items()])
    same(collect(got["lives"], "id", "server_id", "player_id", "life_number", "started_at", "ended_at",
                 "death_cause", "energy_at_death", "playtime_seconds"),
         [(x["id"], x["server"], x["pid"], x["n"], x["start"], x["end"], x["cause"], x["energy"],
           sum(s["secs"] or 0 for s in truth.sessions if s["life"] == x["id"])) for x in truth.lives])
    same(collect(got["sessions"], "id", "server_id", "player_id", "life_id", "connected_at",
                 "disconnected_at", "duration_seconds", "close_reason"),
         [(s["id"], s["server"], s["pid"], s["life"], s["start"], s["end"], s["secs"], s["reason"])
          for s in truth.sessions])
    same(collect(got["kills"], "server_id", "killer_gamertag", "killer_player_id", "victim_player_id",
                 "victim_life_id", "occurred_at"), truth.kills)
    same(collect(got["positions"], "server_id", "player_id", "gamertag", "x", "recorded_at"), truth.fixes)
    same(collect(got["hit_events"], "server_id", "victim_gamertag", "victim_player_id", "occurred_at"),
         truth.hits)
    same(collect(got["build_events"], "server_id", "gamertag", "player_id", "life_id", "occurred_at"),
         truth.builds)
