"""Read API and planners on small seeded tables."""

from datetime import timedelta

import pytest
from helpers import at, collect, table
from pyspark.sql import functions as F

from lifelog.operators import filters, joins
from lifelog.operators.sets import new_notifications
from lifelog.plans import articles as article_plans
from lifelog.plans import bans as ban_plans
from lifelog.plans import ledger, links, notifications
from lifelog.queries import Dataset, accounts, articles, boards, lives, maps, players
from lifelog.schemas import TABLES

SERVERS = [dict(id=1, name="One", map="chernarusplus", slug="one", active=True),
           dict(id=2, name="Two", map="sakhal", slug="two", active=True),
           dict(id=3, name="Old", map="enoch", slug=None, active=True)]


def dataset(spark, now=at(5000), **tables):
    made = {}
    for name in TABLES:
        rows = tables.get(name, SERVERS if name == "servers" else [])
        df = table(spark, name, rows)
        if name in ("positions", "hit_events", "kills", "build_events", "unconscious_events"):
            df = df.withColumn("event_id", F.monotonically_increasing_id())
        made[name] = df
    return Dataset(made, now)


def player(i, seen, name=None):
    return dict(id=i, gamertag=name or f"P{i}", dayz_id=f"h{i}", first_seen_at=at(0), last_seen_at=at(seen))


def life(i, pid, start, end=None, server=1, n=1, cause=None, secs=0, **more):
    return dict(id=i, server_id=server, player_id=pid, life_number=n, started_at=at(start),
                ended_at=None if end is None else at(end), death_cause=cause, playtime_seconds=secs, **more)


def session(i, pid, life_id, start, end=None, server=1):
    return dict(id=i, server_id=server, player_id=pid, life_id=life_id, connected_at=at(start),
                disconnected_at=None if end is None else at(end), duration_seconds=None if end is None else end - start)


def kill(server, pid, victim_life, t, distance=None, tag=None):
    return dict(server_id=server, killer_gamertag=tag or f"P{pid}", killer_player_id=pid, victim_gamertag="V",
                victim_life_id=victim_life, distance=distance, occurred_at=at(t))


def test_survivors_rank_cap_and_qualification(spark):
    d = dataset(
        spark,
        players=[player(1, 400), player(2, 310), player(3, 100), player(4, 310), player(5, 1000)],
        lives=[life(11, 1, 0), life(12, 2, 0), life(13, 3, 0), life(14, 4, 0), life(15, 5, 0, server=3)],
        sessions=[session(21, 1, 11, 0), session(22, 2, 12, 0), session(23, 3, 13, 0), session(24, 4, 14, 0),
                  session(25, 5, 15, 0, server=3)],
        # P3 is short of play time but scored a kill; P4 ties with P2 and has a kill.
        kills=[kill(1, 3, 91, 50, 10.0), kill(1, 4, 92, 60, None), kill(2, 2, 93, 60, 5.0)],
        gamertag_links=[dict(id=1, user_id="u1", gamertag="p1", status="verified"),
                        dict(id=2, user_id="u2", gamertag="P2", status="pending")],
        avatars=[dict(user_id="u1", hash="x"), dict(user_id="u2", hash="y")],
    )
    rows = boards.survivors(d).select("gamertag", "time_alive_seconds", "kills_this_life", "avatar_hash", "total").collect()
    assert sorted(map(tuple, rows), key=lambda r: -r[1] * 100 - r[2]) == [
        ("P1", 400, 0, "x", 4), ("P4", 310, 1, None, 4), ("P2", 310, 0, None, 4), ("P3", 100, 1, None, 4)]
    assert collect(boards.site_stats(d), "deaths", "alive") == [(0, 4)]


def test_stored_and_live_qualification_differ_for_open_lives(spark):
    d = dataset(spark, players=[player(1, 400)], lives=[life(11, 1, 0)], sessions=[session(21, 1, 11, 0)])
    assert d.life_status.where("qualified").count() == 1
    assert article_plans.qualified_lives(d["lives"], d.life_kills, 300).count() == 0


def test_qualified_at_takes_the_earliest_and_prefers_pvp_on_ties(spark):
    d = dataset(
        spark, players=[player(1, 900), player(2, 900), player(3, 900)],
        lives=[life(11, 1, 0, 400, cause="pvp", secs=400), life(12, 2, 0), life(13, 3, 0, 100, cause="pvp", secs=100)],
        sessions=[session(21, 1, 11, 0, 100), session(22, 1, 11, 150, 400), session(23, 2, 12, 0, 50), session(24, 2, 12, 100),
                  session(25, 3, 13, 0, 100)],
        kills=[kill(1, 3, 99, 100)],
    )
    assert collect(d.qualified_at, "life_id", "qualified_at", "qualified_by") == [
        (11, at(350), "playtime"), (12, at(350), "playtime"), (13, at(100), "pvp-death")]


def test_profile_pages_and_server_cards(spark):
    d = dataset(
        spark, players=[player(1, 5000)],
        lives=[life(11, 1, 0, 1000, secs=900, cause="wolf"), life(12, 1, 1100, 1200, n=2, secs=50, cause="died"),
               life(13, 1, 2000, n=3), life(14, 1, 3000, 3500, server=2, secs=500, cause="pvp")],
        sessions=[session(21, 1, 11, 0, 900), session(22, 1, 12, 1100, 1150), session(23, 1, 13, 4000)],
        bans=[dict(id=7, server_id=2, gamertag="P1", life_started_at=at(3000), status="applied", dry_run=False,
                   banned_at=at(3500), expires_at=at(9000))],
        player_gamertags=[dict(player_id=1, gamertag="P1"), dict(player_id=1, gamertag="Old")],
        gamertag_links=[dict(id=1, user_id="u", gamertag="OLD", status="verified")],
    )
    assert collect(players.profiles(d).where("server_id = 1"), "lives", "deaths", "total_playtime_seconds", "current_life_seconds") == [
        (2, 1, 1900, 1000)]
    assert collect(players.standings(d), "slug", "state", "ban_cause", "triggering_life_number", "alive_life_number") == [
        ("one", "alive", None, None, 3), ("two", "banned", "pvp", 1, None)]
    head = players.page_totals(d)
    assert collect(head, "lives", "deaths", "previous_best_seconds", "verified", "alive_anywhere") == [(3, 2, 900, True, True)]
    # Page 9 is clamped to the last page.
    assert collect(players.past_lives(d, 9, 1), "life_id", "page", "total") == [(11, 2, 2)]
    guests = spark.createDataFrame([(1,), (2,)], "player_id long")
    cards, places = players.server_cards(d, guests)
    assert collect(cards, "player_id", "slug", "state") == [(1, "one", "alive"), (1, "two", "banned")]
    assert collect(places, "slug") == [("one",), ("two",)]


def test_priors_usual_cause_and_ties(spark):
    d = dataset(
        spark, players=[player(1, 0)],
        lives=[life(1, 1, 0, 10, cause="pvp", secs=5), life(2, 1, 20, 30, cause="wolf", secs=9, server=2),
               life(3, 1, 40, 50, cause="bear", secs=9), life(4, 1, 60, 70, cause="pvp", secs=1), life(5, 1, 80),
               life(6, 1, 80, server=2)],
        kills=[kill(1, 1, 90, 45), kill(2, 1, 91, 80)],
    )
    got = collect(players.player_priors(d), "life_id", "lives_lived", "longest_life_seconds", "total_kills",
                  "usual_death_cause", "last_death_cause", "best_life_map")
    assert got == [
        (1, 0, 0, 0, None, None, None), (2, 1, 5, 0, "pvp", "pvp", "chernarusplus"),
        (3, 2, 9, 0, "pvp", "wolf", "sakhal"), (4, 3, 9, 1, "animal", "bear", "sakhal"),
        (5, 4, 9, 1, "pvp", "pvp", "sakhal"), (6, 4, 9, 1, "pvp", "pvp", "sakhal")]


def hit(pid, t, kind, label=None, hp=None, tag=None):
    return dict(server_id=1, victim_gamertag=f"P{pid}", victim_player_id=pid, attacker_type=kind, attacker_label=label,
                attacker_gamertag=tag, victim_hp=hp, occurred_at=at(t))


def test_dossier_window_and_verdict(spark):
    d = dataset(
        spark, players=[player(1, 2000), player(2, 2000)],
        lives=[life(11, 1, 0, 1000, cause="died", bleed_sources_at_death=0), life(12, 2, 0)],
        hit_events=[hit(1, 100, "environment", "Fireplace", 50.0), hit(1, 220, "environment", "BigFire"), hit(1, 341, "environment", "fire"),
                    hit(1, 880, "infected", "Infected", 30.0), hit(1, 1000, "infected", "Infected", 0.9), hit(1, 1001, "player"),
                    hit(2, 0, "infected", "Infected"), hit(2, 50, "infected", "Infected")],
        unconscious_events=[dict(server_id=1, player_id=1, gamertag="P1", disconnecting=False, occurred_at=at(879))],
    )
    got = collect(d.verdicts, "life_id", "fire_encounters", "fire_hits", "fire_worst", "infected_hits", "pvp_hits", "hp_low",
                  "recent_hits", "recent_knockouts", "verdict")
    assert [r[:9] for r in got] == [(11, 2, 3, 2, 2, 0, 0.9, 2, 0), (12, 0, 0, 0, 1, 0, None, 1, 0)]
    assert got[0][9].cause == "mauled" and got[1][9] is None
    spans = collect(lives.encounters_of(d), "life_id", "category", "hits")
    assert spans == [(11, "fire", 1), (11, "fire", 2), (12, "infected", 2)]


def test_timeline_groups_quiet_sessions(spark):
    d = dataset(
        spark, now=at(10_000), players=[player(1, 9000)], lives=[life(11, 1, 0)],
        sessions=[session(20 + i, 1, 11, 1000 * i, 1000 * i + 100) for i in range(6)],
        kills=[kill(1, 1, 90, 3050, 7.0)],
    )
    rows = {(r.kind, r.title): r for r in lives.timeline_events(d).collect()}
    assert ("session-group", "Sessions 2–3") in rows and ("session", "Session 4 began") in rows
    assert rows["session-group", "Sessions 5–6"].line == "2 logins"
    assert rows["kill", None].time_label == "0h 05m in" and rows["kill", None].line == "longest kill"
    assert rows["now", "Still drawing breath"].line == "10m"


def test_track_markers_age_and_segments(spark):
    fix = lambda t, x: dict(server_id=1, player_id=1, gamertag="P1", x=x, y=0.0, recorded_at=at(t))
    d = dataset(
        spark, players=[player(1, 5000)],
        lives=[life(11, 1, 0, 2000, cause="died"), life(12, 1, 2500, n=2)],
        sessions=[session(21, 1, 11, 0, 500), session(22, 1, 11, 900, 2000), session(23, 1, 12, 2500)],
        positions=[fix(100, 0.0), fix(200, 10.0), fix(300, 20.0), fix(700, 90.0), fix(1000, 200.0), fix(2600, 0.0)],
        kills=[kill(1, 1, 90, 1900), kill(1, 1, 91, 1901)],
    )
    t = lives.life_track(d)
    assert collect(t["points"], "session_id", "x") == [(21, 0.0), (21, 20.0), (22, 200.0), (23, 0.0)]
    assert collect(t["markers"], "life_id", "kind", "x", "sample_age_seconds") == [
        (11, "kill", 200.0, 900), (12, "now", 0.0, 0)]
    assert collect(t["summary"], "life_id", "sample_count", "kept") == [(11, 5, 4), (12, 1, 1)]


def sharing(spark, **changes):
    fix = lambda pid, t, server=1: dict(server_id=server, player_id=pid, gamertag=f"P{pid}", x=float(pid), y=0.0,
                                        recorded_at=at(t))
    base = dict(
        now=at(2000), players=[player(1, 1900), player(2, 1900)],
        lives=[life(11, 1, 0), life(12, 2, 0)],
        sessions=[session(21, 1, 11, 0), session(22, 2, 12, 100)],
        gamertag_links=[dict(id=1, user_id="u1", gamertag="p1", status="verified"),
                        dict(id=2, user_id="u2", gamertag="P2", status="verified")],
        location_shares=[dict(granter_user_id="u2", grantee_user_id="u1", server_id=1, granter_session_connected_at=at(100))],
        positions=[fix(1, 1100), fix(2, 1500)],
    )
    base.update(changes)
    return dataset(spark, **base)


@pytest.mark.parametrize("share,seen", [
    (dict(), True),
    (dict(granter_session_connected_at=at(99)), False),
    (dict(server_id=2), False),
    (dict(granter_user_id="u1", grantee_user_id="u2"), False),
])
def test_shares_hold_for_one_session_server_and_direction(spark, share, seen):
    row = dict(granter_user_id="u2", grantee_user_id="u1", server_id=1, granter_session_connected_at=at(100))
    d = sharing(spark, location_shares=[{**row, **share}])
    got = collect(maps.shared_positions(d).where("viewer_user_id = 'u1'"), "gamertag", "is_self")
    assert got == ([("P2", False)] if seen else []) + [("p1", True)]
    if seen:
        online = maps.online_players(d, "u1", maps.shared_positions(d))
        assert collect(online, "gamertag", "rank") == [("P1", 0), ("P2", 1)]
        assert collect(maps.sharing_with(d), "granter_user_id", "grantee_gamertag") == [("u2", "p1")]


def test_stale_self_fix_is_kept_and_presence_is_per_server(spark):
    d = sharing(spark, now=at(3000))
    # Both fixes are stale: others vanish, the viewer's own last fix stays.
    assert collect(maps.shared_positions(d), "viewer_user_id", "gamertag", "is_self") == [("u1", "p1", True), ("u2", "P2", True)]
    assert maps.online_now(d).count() == 0
    hop = sharing(spark, positions=[dict(server_id=2, player_id=1, gamertag="P1", x=0.0, y=0.0, recorded_at=at(1999))])
    assert maps.online_now(hop).count() == 0


def test_rename_reopens_a_ban_unless_aliases_are_used(spark):
    d = dataset(
        spark, players=[player(1, 0, "New")], lives=[life(11, 1, 0, 400, secs=400)],
        bans=[dict(id=1, server_id=1, gamertag="Old", life_started_at=at(0), status="applied", dry_run=False)],
        player_gamertags=[dict(player_id=1, gamertag="Old"), dict(player_id=1, gamertag="New")],
    )
    plan = lambda **k: ban_plans.plan_bans(d["lives"], d["players"], d["bans"], d.label_kills, 24, **k)
    assert collect(plan(), "gamertag", "qualified_by", "expires_at") == [("New", "playtime", at(400) + timedelta(hours=24))]
    assert plan(aliases=d["player_gamertags"]).count() == 0
    assert collect(joins.resolve_slugs(spark.createDataFrame([("OLD",), ("new",), ("x",)], "name string"), "name",
                                       d["players"], d["player_gamertags"]), "name", "player_id", "via_alias") == [
        ("OLD", 1, True), ("new", 1, False), ("x", None, False)]


def test_ban_transitions(spark):
    ban = lambda i, s, e=None: dict(id=i, status=s, expires_at=e)
    bans = table(spark, "bans", [ban(1, "pending"), ban(2, "applied", at(10)), ban(3, "applied", at(11)), ban(4, "lift_pending"),
                                 ban(5, "applied"), ban(6, "lifted")])
    now = F.lit(at(10)).cast("timestamp")
    assert collect(ban_plans.ban_transitions(bans, now), "ban_id", "new_status") == [
        (1, "applied"), (2, "expired"), (4, "lifted")]
    assert collect(filters.due_expiries(bans, now), "id") == [(2,)]


def test_grants_are_idempotent(spark):
    link = lambda i, u, s="verified": dict(id=i, user_id=u, gamertag=f"g{i}", status=s)
    tags = table(spark, "gamertag_links", [link(1, "a"), link(2, "a"), link(3, "b"), link(4, "c", "pending")])
    refs = table(spark, "referrals", [dict(user_id="a", referrer_user_id="b"), dict(user_id="c", referrer_user_id="b")])
    old = table(spark, "token_transactions", [dict(id=1, user_id="a", delta=1, idempotency_key="verify:1")])
    got = ledger.plan_grants(tags, refs, old, "2026-01")
    assert collect(got, "idempotency_key") == [(k,) for k in sorted(
        ["verify:2", "verify:3", "monthly:a:2026-01", "monthly:b:2026-01", "referral:b:a"])]
    again = old.select("idempotency_key").unionByName(got.select("idempotency_key"))
    assert ledger.plan_grants(tags, refs, again, "2026-01").count() == 0
    buys = spark.createDataFrame([("s", "a", 3), ("t", "a", 0), ("u", "a", 101)], "session_id string, user_id string, quantity int")
    paid = spark.createDataFrame([("stripe:s:2",)], "idempotency_key string")
    grants, refused = ledger.expand_purchases(buys, paid)
    assert collect(grants, "idempotency_key") == [("stripe:s:1",), ("stripe:s:3",)]
    assert collect(refused, "session_id", "quantity") == [("t", 0), ("u", 101)]


def test_targets_outcomes_and_push(spark):
    art = lambda i, **k: dict(id=i, kind="obituary", status="published", slug=f"s{i}", headline="h", lede="l",
                              death_at=at(i), server_id=1, gamertag="OLD", life_started_at=at(0), attempts=1, **k)
    posts = table(spark, "articles", [art(1), art(2)])
    log = table(spark, "syndications", [dict(slug="s1", channel="a", posted_at=at(9), attempts=1),
                                        dict(slug="s2", channel="a", attempts=3)])
    since = F.lit(at(0)).cast("timestamp")
    got = article_plans.syndication_targets(posts, log, ["a", "b"], since, max_attempts=3)
    assert collect(got, "slug", "channel") == [("s1", "b"), ("s2", "b")]
    assert article_plans.syndication_targets(posts, log, [], since, limit=9, max_attempts=3).count() == 0
    done = spark.createDataFrame([("s1", "b", True, at(5), None), ("s2", "a", False, at(5), "no")],
                                 "slug string, channel string, ok boolean, at timestamp, error string")
    assert collect(article_plans.apply_outcomes(log, done, ["slug", "channel"]), "slug", "channel", "attempts", "posted_at", "last_error") == [
        ("s1", "a", 1, at(9), None), ("s1", "b", 1, at(5), None), ("s2", "a", 4, None, "no")]
    d = dataset(spark, players=[player(1, 0, "New")], lives=[life(11, 1, 0, 400, secs=400), life(12, 1, 500, 900, secs=400)],
                articles=[art(1)], player_gamertags=[dict(player_id=1, gamertag="Old"), dict(player_id=1, gamertag="New")])
    due = article_plans.obituary_targets(
        article_plans.qualified_lives(d["lives"], d.life_kills, 300), d["players"], d["servers"], d["articles"],
        d["player_gamertags"], since, limit=5, max_attempts=3)
    assert collect(due, "life_id") == [(12,)]
    notes = table(spark, "notifications", [dict(id=1, user_id="a", created_at=at(0)), dict(id=2, user_id="a", created_at=at(1000)),
                                           dict(id=3, user_id="b", created_at=at(1000)), dict(id=4, user_id="a", pushed_at=at(1))])
    subs = table(spark, "push_subscriptions", [dict(id=7, user_id="a", failure_count=4), dict(id=8, user_id="b", disabled_at=at(0))])
    now = F.lit(at(1200)).cast("timestamp")
    assert collect(notifications.plan_push(notes, subs, now, 10), "id", "action", "subscription_id") == [
        (1, "skip_old", None), (2, "send", 7), (3, "skip_none", None)]
    failed = spark.createDataFrame([(7,)], "id long")
    assert collect(article_plans.record_push_failures(subs, failed, now), "id", "failure_count", "disabled_at") == [(7, 5, at(1200))]


def test_verification_effects_and_drafts(spark):
    tags = table(spark, "gamertag_links", [
        dict(id=1, user_id="a", gamertag="Tag", status="verified", verified_at=at(10)),
        dict(id=2, user_id="b", gamertag="TAG", status="pending"), dict(id=3, user_id="c", gamertag="else", status="pending")])
    shares = table(spark, "location_shares", [dict(granter_user_id="a", grantee_user_id="z", server_id=1),
                                              dict(granter_user_id="z", grantee_user_id="a", server_id=1)])
    won = spark.createDataFrame([(1,)], "link_id long")
    rivals, ended = links.verification_effects(won, tags, shares)
    assert collect(rivals, "id") == [(2,)] and collect(ended, "granter_user_id") == [("a",)]
    rows = table(spark, "token_transactions", [dict(id=5, user_id="a", kind="transfer_in", created_at=at(20)),
                                               dict(id=6, user_id="a", kind="redeem", created_at=at(20))])
    drafts = notifications.draft_account(tags, rows, F.lit(at(10)).cast("timestamp"))
    assert collect(drafts, "natural_key", "kind") == [("gamertag_verified:1", "gamertag_verified"), ("tokens:5", "tokens_received")]
    stored = drafts.where("natural_key = 'tokens:5'")
    assert collect(new_notifications([drafts, drafts], stored), "natural_key") == [("gamertag_verified:1",)]
    day = 86_400
    d = dataset(spark, now=at(15 * day), players=[player(1, 400)], lives=[life(11, 1, 0)], sessions=[session(21, 1, 11, 0)],
                gamertag_links=[dict(id=1, user_id="u", gamertag="p1", status="verified")])
    got = notifications.draft_milestones(d, F.lit(at(10 * day)).cast("timestamp"))
    assert collect(got, "natural_key", "href") == [("milestone:14d:11", "/players/p1/one/lives/1")]
    start = filters.window_start(F.lit(None).cast("timestamp"), F.lit(at(0)).cast("timestamp"), 1)
    assert tags.where(F.col("verified_at") >= start).count() == 0


def test_articles_and_accounts(spark):
    rows = [dict(id=1, kind="obituary", status="published", slug="a", gamertag="G", map="enoch", life_number=1, death_at=at(1),
                 pull_quote_text="q", facts='{"sessions": 3, "verdict": {"cause": "fall"}}',
                 body_blocks='[{"type": "list", "items": ["x"]}]'),
            dict(id=2, kind="obituary", status="published", slug="b", map="enoch", life_number=1)]
    df = table(spark, "articles", rows)
    good, corrupt = articles.published_obituaries(df)
    assert collect(good, "id") == [(1,)] and collect(corrupt, "id") == [(2,)]
    page = articles.obituary(df, "a").first()
    assert page.facts.sessions == 3 and page.facts.verdict.conditions == [] and page.body == ""
    assert page.pull_quote.attribution == "" and page.body_blocks[0]["items"] == ["x"]
    tags = table(spark, "gamertag_links", [dict(id=1, user_id="u", gamertag="g", status="pending")])
    ch = table(spark, "verification_challenges", [
        dict(id=1, gamertag_link_id=1, sequence=["EmoteClap"], progress_index=0, issued_at=at(0), expires_at=at(10)),
        dict(id=2, gamertag_link_id=1, sequence=["EmoteThumb", "Odd"], progress_index=1, issued_at=at(1), expires_at=at(11))])
    got = accounts.links_with_challenge(tags, ch, at(11)).first()
    assert (got.steps, got.progress_index, got.expired) == (["thumbs up", "Odd"], 1, False)
    ledger_rows = table(spark, "token_transactions", [dict(id=i, user_id="u", delta=1) for i in range(4)])
    assert collect(accounts.wallet(ledger_rows, 2), "id", "balance") == [(2, 4), (3, 4)]
    notes = table(spark, "notifications", [dict(id=i, user_id="u", created_at=at(i), read_at=at(9) if i else None) for i in range(3)])
    assert collect(accounts.inbox(notes, 2, 2), "id", "total", "unread") == [(0, 3, 1)]
