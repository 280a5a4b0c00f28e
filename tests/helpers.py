"""Small-fixture helpers and a sequential re-statement of the fold used as ground truth."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from lifelog.schemas import TABLES

T0 = datetime(2026, 1, 1, 12, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def table(spark, name, rows):
    """DataFrame of a named table from dicts; missing columns are null."""
    schema = TABLES[name]
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def event_rows(spark, events):
    """events: list of (server_id, type, seconds, payload); event ids are 1, 2, 3, ..."""
    rows = [
        (i + 1, s, 1, i, 0, t, at(sec), json.dumps(p), None)
        for i, (s, t, sec, p) in enumerate(events)
    ]
    from lifelog.schemas import EVENTS

    return spark.createDataFrame(rows, EVENTS)


def connect(gamertag, account):
    return {"gamertag": gamertag, "dayzId": account}


def died(victim, cause="died", killer=None, weapon=None, distance=None, **vitals):
    return {"victim": victim, "cause": cause, "killer": killer, "weapon": weapon,
            "distance": distance, **vitals}


def collect(df, *columns):
    rows = df.select(*columns).collect()
    return sorted((tuple(r) for r in rows), key=repr)


class SequentialFold:
    """One event at a time, as a plain state machine."""

    def __init__(self):
        self.people, self.lives, self.sessions, self.kills = {}, [], [], []
        self.fixes, self.hits, self.knockouts, self.builds = [], [], [], []

    def holder(self, label):
        named = [p for p in self.people.values() if p["label"].lower() == label.lower()]
        return max(named, key=lambda p: (p["seen"], -p["id"]), default=None)

    def open_life(self, server, pid):
        return next((x for x in self.lives if x["server"] == server and x["pid"] == pid and x["end"] is None), None)

    def open_session(self, server, pid):
        return next((x for x in self.sessions if x["server"] == server and x["pid"] == pid and x["end"] is None), None)

    def close(self, session, when, reason, cap=None):
        end = when if cap is None else min(when, max(cap, session["start"]))
        session.update(end=end, reason=reason, secs=max(0, int((end - session["start"]).total_seconds())))

    def apply(self, eid, server, kind, when, p):
        if kind == "player.connected":
            me = self.people.get(p["dayzId"])
            before = me["seen"] if me else None
            if not me:
                me = self.people[p["dayzId"]] = {"id": eid}
            me.update(seen=when, label=p["gamertag"])
            open_ = self.open_session(server, me["id"])
            if open_:
                self.close(open_, when, "superseded", before)
            life = self.open_life(server, me["id"])
            if not life:
                n = 1 + sum(x["server"] == server and x["pid"] == me["id"] for x in self.lives)
                life = dict(id=eid, server=server, pid=me["id"], n=n, start=when, end=None, cause=None,
                            energy=None)
                self.lives.append(life)
            self.sessions.append(dict(id=eid, server=server, pid=me["id"], life=life["id"], start=when,
                                      end=None, reason=None, secs=None))
        elif kind == "player.disconnected":
            me = self.holder(p["gamertag"])
            if me:
                me["seen"] = when
                open_ = self.open_session(server, me["id"])
                if open_:
                    self.close(open_, when, "clean")
        elif kind == "player.died":
            me = self.holder(p["victim"])
            if not me:
                return
            life = self.open_life(server, me["id"])
            if not life:
                past = [x for x in self.lives if x["server"] == server and x["pid"] == me["id"] and x["end"] == when]
                if past:
                    target = max(past, key=lambda x: x["id"])
                    if target["cause"] == "died" and p["cause"] not in ("died", "unknown"):
                        target["cause"] = p["cause"]
                    if target["energy"] is None:
                        target["energy"] = p.get("energy")
                return
            open_ = self.open_session(server, me["id"])
            if open_:
                self.close(open_, when, "clean")
            life.update(end=when, cause=p["cause"], energy=p.get("energy"))
            if p["cause"] == "pvp" and p.get("killer") and p["killer"] != p["victim"]:
                killer = self.holder(p["killer"])
                self.kills.append((server, p["killer"], killer and killer["id"], me["id"], life["id"], when))
        elif kind == "server.rebooted":
            for s in self.sessions:
                if s["server"] == server and s["end"] is None:
                    seen = next(q["seen"] for q in self.people.values() if q["id"] == s["pid"])
                    self.close(s, when, "reboot", seen)
        elif kind == "player.position":
            me = self.holder(p["gamertag"])
            if me:
                me["seen"] = when
                self.fixes.append((server, me["id"], me["label"], p["x"], when))
        elif kind == "player.hit":
            me = self.holder(p["victim"])
            self.hits.append((server, p["victim"], me and me["id"], when))
        elif kind == "build.placed":
            me = self.holder(p["gamertag"])
            life = None
            if me:
                inside = [x for x in self.lives if x["server"] == server and x["pid"] == me["id"]
                          and x["start"] <= when and (x["end"] is None or x["end"] > when)]
                life = max(inside, key=lambda x: (x["start"], x["id"]))["id"] if inside else None
            self.builds.append((server, p["gamertag"], me and me["id"], life, when))
