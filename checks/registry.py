"""Every registered query: name -> (DataFrame builder, oracle SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.fixed import EMOTES
from lifelog.functions import scalars as X
from lifelog.operators import aggregates as A
from lifelog.operators import filters as C
from lifelog.operators import joins as J
from lifelog.operators import paging as T
from lifelog.operators import sets as U
from lifelog.operators import text as TX
from lifelog.operators import tracks as K
from lifelog.operators import windows as W
from lifelog.operators.ordered import first_by, latest_by
from lifelog.plans import articles as PA
from lifelog.plans import bans as PB
from lifelog.plans import ledger as PL
from lifelog.plans import links as PK
from lifelog.plans import notifications as PN
from lifelog.queries import accounts, articles, boards, lives, maps, players
from lifelog.sources import backfill as BF
from lifelog.sources import extract as EX
from lifelog.sources import logs as L
from lifelog.sources import tables as S
from lifelog.sources.payload import typed_events, validate_events
from lifelog.staging import stage_root
from lifelog.streaming import append_once, presence_spans, read_projection, stream_encounters

from .base_sql import FRESH, GAP, NOW, QUALIFY, RECENT, SINCE, seconds, with_base
from .bindings import NOW as NOW_VALUE
from .bindings import SINCE as SINCE_VALUE
from .bindings import World, ntz, world

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[World], DataFrame], sql: str | None, extra: str = "", base: bool = True):
    QUERIES[name] = lambda spark, sf_dir: ntz(build(world(spark, sf_dir)))
    if sql is not None:
        ORACLE[name] = with_base(sql, extra) if base else sql


def now():
    return X.instant(NOW_VALUE)


def since():
    return X.instant(SINCE_VALUE)


# --- projections ---------------------------------------------------------------------------

add("players", lambda w: w.projections.players.select("id", "gamertag", "dayz_id", "first_seen_at", "last_seen_at"),
    "SELECT player_id AS id, gamertag, dayz_id, first_seen_at, last_seen_at FROM players")
add("aliases", lambda w: w.projections.player_gamertags,
    """SELECT player_id, 'P' || user_id AS gamertag, min(tm) AS first_seen_at, max(tm) AS last_seen_at
       FROM r WHERE t = 'connect' GROUP BY player_id, user_id""")
add("resolved_labels",
    lambda w: w.projections.resolved.where(F.col("type") != "server.rebooted").select("event_id", "type", "player_id"),
    """SELECT event_id, CASE t WHEN 'connect' THEN 'player.connected' WHEN 'leave' THEN 'player.disconnected'
         WHEN 'die' THEN 'player.died' WHEN 'down' THEN 'player.unconscious' WHEN 'build' THEN 'build.placed'
         WHEN 'fix' THEN 'player.position' ELSE 'player.hit' END AS type, player_id
       FROM r WHERE t <> 'boot'""")
add("heartbeats", lambda w: w.projections.heartbeats,
    """SELECT player_id, event_id, tm AS occurred_at,
         lag(tm) OVER (PARTITION BY player_id ORDER BY event_id) AS seen_before, tm AS seen_after FROM touch""")
add("lives", lambda w: w.projections.lives,
    """SELECT id, server_id, player_id, life_number, started_at, ended_at, death_cause, death_by_gamertag,
         death_weapon, death_distance, energy_at_death, water_at_death, bleed_sources_at_death,
         playtime_seconds, end_event_id FROM lives""")
add("sessions", lambda w: w.projections.sessions,
    """SELECT id, server_id, player_id, life_id, connected_at, disconnected_at, duration_seconds, close_reason
       FROM sess""")
add("kills", lambda w: w.projections.kills,
    """SELECT server_id, killer_gamertag, killer_player_id, victim_gamertag, victim_player_id, victim_life_id,
         weapon, distance, occurred_at, event_id FROM kills""")
add("hits", lambda w: w.projections.hit_events.drop("x", "y"),
    """SELECT event_id, server_id, victim_gamertag, victim_player_id, attacker_gamertag, attacker_type,
         attacker_label, body_part, victim_hp, occurred_at FROM hits""")
add("builds", lambda w: w.projections.build_events.select(
        "event_id", "server_id", "gamertag", "player_id", "life_id", "action", "object", "occurred_at"),
    "SELECT event_id, server_id, gamertag, player_id, life_id, action, object, occurred_at FROM builds")
add("positions", lambda w: w.projections.positions, "SELECT * FROM fixes")
add("knockouts", lambda w: w.projections.unconscious_events.drop("event_id"), "SELECT * FROM downs")
add("valid_events",
    lambda w: validate_events(w.events)[0]
    .groupBy("type").agg(F.count("*").alias("n")),
    """SELECT CASE t WHEN 'connect' THEN 'player.connected' WHEN 'leave' THEN 'player.disconnected'
         WHEN 'die' THEN 'player.died' WHEN 'down' THEN 'player.unconscious' WHEN 'build' THEN 'build.placed'
         WHEN 'boot' THEN 'server.rebooted' WHEN 'fix' THEN 'player.position' ELSE 'player.hit' END AS type,
         count(*) AS n FROM ev GROUP BY t""")

# --- filters --------------------------------------------------------------------------------

add("qualified_lives_live", lambda w: w.dataset.life_status.where("qualified").select("id", "seconds", "kills_counted"),
    "SELECT id, CAST(seconds AS BIGINT) AS seconds, kills_counted FROM status WHERE qualified")
add("qualified_lives_stored",
    lambda w: PA.qualified_lives(w.projections.lives, w.dataset.life_kills, QUALIFY).select("id"),
    f"""SELECT id FROM lives WHERE death_cause = 'pvp' OR playtime_seconds >= {QUALIFY}
        OR id IN (SELECT life_id FROM life_kills)""")
add("live_servers", lambda w: C.live_servers(w.servers).select("id", "slug"), "SELECT id, slug FROM live")
add("search_labels", lambda w: C.search_labels(w.claims, "customer#00000001", 15),
    """SELECT gamertag FROM claims WHERE gamertag ILIKE 'customer#00000001%' ORDER BY gamertag LIMIT 15""")
add("window_start_candidates",
    lambda w: w.notifications.where(F.col("created_at") >= C.window_start(since(), now(), 24 * 14)).groupBy("kind").agg(
        F.count("*").alias("n")),
    f"""SELECT kind, count(*) AS n FROM notifications
        WHERE created_at >= greatest({SINCE}, {NOW} - INTERVAL 336 HOUR) GROUP BY kind""")
add("same_label_links",
    lambda w: w.links.join(w.projections.players.withColumnRenamed("gamertag", "name").select("id", "name")
                           .withColumnRenamed("id", "player_id"),
                           C.same_label(F.col("gamertag"), F.col("name"))).select("user_id", "player_id"),
    "SELECT l.user_id, p.player_id FROM links l JOIN players p ON lower(l.gamertag) = lower(p.gamertag)")
add("due_expiries", lambda w: C.due_expiries(w.bans, since()).select("id", "expires_at"),
    f"SELECT id, expires_at FROM bans WHERE status = 'applied' AND expires_at <= {SINCE}")

# --- joins ----------------------------------------------------------------------------------

add("lives_players_servers",
    lambda w: J.with_servers(J.with_players(w.projections.lives, w.projections.players), w.servers)
    .select("id", "gamertag", "server_name", "map"),
    "SELECT n.id, n.gamertag, s.name AS server_name, s.map FROM named n JOIN servers s ON s.id = n.server_id")
add("lives_open_session", lambda w: J.with_open_session(w.projections.lives, w.projections.sessions).select("id", "connected_at"),
    "SELECT l.id, o.connected_at FROM lives l LEFT JOIN open_sess o USING (id)")
add("resolve_links",
    lambda w: J.resolve_links(w.links, w.projections.players).select("link_id", "user_id", "player_id"),
    """SELECT l.id AS link_id, l.user_id, p.player_id FROM links l
       JOIN players p ON lower(p.gamertag) = lower(l.gamertag) WHERE l.status = 'verified'""")
add("resolve_slugs",
    lambda w: J.resolve_slugs(w.links.select("user_id", "gamertag"), "gamertag", w.projections.players,
                              w.projections.player_gamertags).select("user_id", "player_id", "via_alias"),
    """SELECT l.user_id, p.player_id, false AS via_alias FROM links l
       LEFT JOIN players p ON lower(p.gamertag) = lower(l.gamertag)""")
add("life_at",
    lambda w: J.life_at(w.projections.unconscious_events, w.projections.lives)
    .select("server_id", "player_id", "occurred_at", "life_id"),
    """SELECT d.server_id, d.player_id, d.occurred_at,
         (SELECT arg_max(l.id, l.started_at) FROM lives l WHERE l.server_id = d.server_id
            AND l.player_id = d.player_id AND l.started_at <= d.occurred_at
            AND (l.ended_at IS NULL OR l.ended_at > d.occurred_at)) AS life_id FROM downs d""")
add("life_kills", lambda w: w.dataset.life_kills.select("life_id", "victim_gamertag", "weapon", "distance", "occurred_at"),
    "SELECT life_id, victim_gamertag, weapon, distance, occurred_at FROM life_kills")
add("life_kills_by_label", lambda w: w.dataset.label_kills.select("life_id", "victim_gamertag", "occurred_at"),
    "SELECT life_id, victim_gamertag, occurred_at FROM label_kills")
add("life_hits", lambda w: w.dataset.life_hits.select("life_id", "event_id", "attacker_type"),
    "SELECT life_id, event_id, attacker_type FROM life_hits")
add("dossier_hits", lambda w: lives.dossier_hits(w.dataset).select("life_id", "event_id"),
    "SELECT life_id, event_id FROM dossier_hits")
add("asof_fix",
    lambda w: J.asof_fix(
        w.projections.kills.where(F.col("killer_player_id").isNotNull())
        .select("server_id", F.col("killer_player_id").alias("player_id"), "victim_life_id", "occurred_at"),
        w.projections.positions, "occurred_at", FRESH).select("victim_life_id", "x", "y", "sample_at", "sample_age_seconds"),
    f"""SELECT k.victim_life_id, f.x, f.y, f.recorded_at AS sample_at,
          CAST(floor(((epoch_us(k.occurred_at) // 1000) - (epoch_us(f.recorded_at) // 1000)) / 1000.0 + 0.5) AS BIGINT) AS sample_age_seconds
        FROM kills k ASOF JOIN fixes f ON f.server_id = k.server_id AND f.player_id = k.killer_player_id
          AND k.occurred_at >= f.recorded_at
        WHERE floor(((epoch_us(k.occurred_at) // 1000) - (epoch_us(f.recorded_at) // 1000)) / 1000.0 + 0.5) <= {FRESH}""")
add("unbanned_lives", lambda w: J.unbanned_lives(w.projections.lives, w.projections.players, w.bans).select("id"),
    """SELECT id FROM named n WHERE ended_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bans b
         WHERE b.server_id = n.server_id AND b.gamertag = n.gamertag AND b.life_started_at = n.started_at)""")
add("unbanned_lives_any_alias",
    lambda w: J.unbanned_lives(w.projections.lives, w.projections.players, w.bans, w.projections.player_gamertags).select("id"),
    """SELECT id FROM named n WHERE ended_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bans b
         WHERE b.server_id = n.server_id AND lower(b.gamertag) = lower(n.gamertag)
           AND b.life_started_at = n.started_at)""")
add("obituary_targets",
    lambda w: PA.obituary_targets(
        PA.qualified_lives(w.projections.lives, w.dataset.life_kills, QUALIFY), w.projections.players, w.servers,
        w.articles, w.projections.player_gamertags, since(), max_attempts=3)
    .select("life_id", "gamertag", "map", "ended_at"),
    f"""SELECT n.id AS life_id, n.gamertag, s.map, n.ended_at FROM named n JOIN servers s ON s.id = n.server_id
        WHERE n.ended_at >= {SINCE}
          AND (n.death_cause = 'pvp' OR n.playtime_seconds >= {QUALIFY} OR n.id IN (SELECT life_id FROM life_kills))
          AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.server_id = n.server_id
            AND lower(a.gamertag) = lower(n.gamertag) AND a.life_started_at = n.started_at
            AND (a.status = 'published' OR a.attempts >= 3))""")
add("syndication_targets",
    lambda w: PA.syndication_targets(w.articles, w.syndications, ["chat", "social"], since(), max_attempts=3)
    .select("slug", "channel", "headline"),
    f"""SELECT a.slug, c.channel, a.headline FROM articles a CROSS JOIN (VALUES ('chat'), ('social')) c(channel)
        LEFT JOIN syndications s ON s.slug = a.slug AND s.channel = c.channel
        WHERE a.status = 'published' AND a.death_at > {SINCE} AND s.posted_at IS NULL AND coalesce(s.attempts, 0) < 3""")
add("claimable", lambda w: J.claimable(w.projections.players, w.links),
    """SELECT gamertag FROM players WHERE gamertag NOT IN (SELECT gamertag FROM links WHERE status = 'verified')""")
add("effective_shares",
    lambda w: J.effective_shares(w.shares, w.links, w.projections.players, w.projections.sessions)
    .select("granter_user_id", "grantee_user_id", "server_id"),
    """SELECT h.granter_user_id, h.grantee_user_id, h.server_id FROM shares h
       JOIN links l ON l.user_id = h.granter_user_id AND l.status = 'verified'
       JOIN players p ON lower(p.gamertag) = lower(l.gamertag)
       JOIN sessions s ON s.player_id = p.player_id AND s.server_id = h.server_id AND s.disconnected_at IS NULL
        AND s.connected_at = h.granter_session_connected_at""")
add("filed_obituaries",
    lambda w: J.filed_obituaries(w.dataset.life_status.where("qualified"), w.articles, w.projections.player_gamertags,
                                 w.servers).select("player_id", "life_id", "slug", "map_slug", "death_at"),
    """SELECT n.player_id, n.id AS life_id, a.slug, v.slug AS map_slug, a.death_at
       FROM status n JOIN articles a ON a.server_id = n.server_id AND a.life_started_at = n.started_at
         AND lower(a.gamertag) = lower(n.gamertag) AND a.status = 'published'
       JOIN live v ON v.id = n.server_id WHERE n.qualified AND n.ended_at IS NOT NULL""")
add("owned_bans",
    lambda w: J.owned_bans(w.links, w.bans, w.projections.players, w.projections.player_gamertags)
    .select("user_id", "ban_id", "status"),
    """SELECT l.user_id, b.id AS ban_id, b.status FROM bans b JOIN links l ON lower(l.gamertag) = lower(b.gamertag)
       WHERE l.status = 'verified' AND b.status IN ('pending', 'applied') AND NOT b.dry_run""")
add("avatar_hash",
    lambda w: J.avatar_hash(w.projections.players.select(F.col("id").alias("player_id"), "gamertag"), w.links, w.avatars,
                            w.projections.player_gamertags),
    """SELECT p.player_id, p.gamertag, a.hash AS avatar_hash FROM players p
       LEFT JOIN links l ON lower(l.gamertag) = lower(p.gamertag) AND l.status = 'verified'
       LEFT JOIN avatars a ON a.user_id = l.user_id""")

# --- aggregates -----------------------------------------------------------------------------

add("kill_counts_by_id", lambda w: A.kill_counts(w.projections.kills),
    """SELECT server_id, killer_player_id, count(*) AS kills FROM kills WHERE killer_player_id IS NOT NULL
       GROUP BY ALL""")
add("kill_counts_by_label", lambda w: A.kill_counts(w.projections.kills, "label"),
    "SELECT server_id, killer_gamertag, count(*) AS kills FROM kills GROUP BY ALL")
add("longest_kill", lambda w: A.longest_kill(w.projections.kills, ["server_id", "killer_gamertag"]),
    "SELECT server_id, killer_gamertag, max(distance) AS longest_kill_meters FROM kills GROUP BY ALL")
add("balances", lambda w: A.balances(w.ledger, w.claims),
    """SELECT c.user_id, CAST(coalesce(sum(l.delta), 0) AS BIGINT) AS balance
       FROM claims c LEFT JOIN ledger l USING (user_id) GROUP BY c.user_id""")
add("referral_counts", lambda w: A.referral_counts(w.referrals, w.claims),
    """SELECT r.referrer_user_id, count(DISTINCT r.user_id) AS referees FROM referrals r
       JOIN claims c ON c.user_id = r.user_id AND c.status = 'verified' GROUP BY r.referrer_user_id""")
add("inbox_counts", lambda w: A.inbox_counts(w.notifications),
    """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE read_at IS NULL) AS unread
       FROM notifications GROUP BY user_id""")
add("usual_cause", lambda w: w.dataset.priors.select("life_id", "usual_death_cause"),
    """SELECT n.id AS life_id, (SELECT f.fam FROM (
           SELECT CASE WHEN death_cause IN ('wolf', 'bear', 'animal') THEN 'animal' ELSE death_cause END AS fam,
                  count(*) AS n, min(started_at) AS first_at
           FROM lives p WHERE p.player_id = n.player_id AND p.started_at < n.started_at AND p.death_cause IS NOT NULL
           GROUP BY 1) f ORDER BY f.n DESC, f.first_at LIMIT 1) AS usual_death_cause FROM lives n""")
add("verified_users", lambda w: A.verified_users(w.claims),
    "SELECT DISTINCT user_id FROM claims WHERE status = 'verified'")
add("duplicate_keys", lambda w: A.duplicate_keys(w.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""", base=False)
add("ordeal_summaries", lambda w: A.ordeal_summaries(lives.dossier_hits(w.dataset), GAP),
    "SELECT life_id, ordeal, encounters, hits, worst FROM ordeals")
add("life_ordeals",
    lambda w: A.life_ordeals(w.projections.lives, lives.dossier_hits(w.dataset), w.projections.build_events,
                             w.projections.sessions, GAP)
    .select("life_id", "fire_encounters", "infected_hits", "pvp_worst", "hp_low", "builds_placed", "session_count"),
    """SELECT l.id AS life_id,
         coalesce((SELECT encounters FROM ordeals o WHERE o.life_id = l.id AND ordeal = 'fire'), 0) AS fire_encounters,
         coalesce((SELECT hits FROM ordeals o WHERE o.life_id = l.id AND ordeal = 'infected'), 0) AS infected_hits,
         coalesce((SELECT worst FROM ordeals o WHERE o.life_id = l.id AND ordeal = 'pvp'), 0) AS pvp_worst,
         (SELECT min(victim_hp) FROM dossier_hits h WHERE h.life_id = l.id) AS hp_low,
         (SELECT count(*) FROM builds b WHERE b.life_id = l.id) AS builds_placed,
         (SELECT count(*) FROM sessions s WHERE s.life_id = l.id) AS session_count FROM lives l""")

# --- windows --------------------------------------------------------------------------------

add("latest_fix",
    lambda w: latest_by(w.projections.positions, ["player_id"], [F.col("recorded_at"), F.col("event_id")])
    .select("player_id", "server_id", "x", "y", "recorded_at"),
    """SELECT player_id, server_id, x, y, recorded_at FROM fixes
       QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY recorded_at DESC, event_id DESC) = 1""")
add("first_fix",
    lambda w: first_by(w.projections.positions, ["server_id", "player_id"], [F.col("recorded_at"), F.col("event_id")])
    .select("player_id", "server_id", "x", "recorded_at"),
    """SELECT player_id, server_id, x, recorded_at FROM fixes
       QUALIFY row_number() OVER (PARTITION BY server_id, player_id ORDER BY recorded_at, event_id) = 1""")
add("qualified_at", lambda w: w.dataset.qualified_at, "SELECT life_id, qualified_at, qualified_by FROM qat")
add("qualified_by", lambda w: w.dataset.life_status.where("qualified").select(
        "id", PB.qualified_by(F.col("death_cause"), F.col("kills_counted")).alias("qualified_by")),
    """SELECT id, CASE WHEN death_cause = 'pvp' THEN 'pvp-death' WHEN kills_counted > 0 THEN 'kill'
         ELSE 'playtime' END AS qualified_by FROM status WHERE qualified""")
add("life_encounters", lambda w: lives.encounters_of(w.dataset), "SELECT * FROM encounters")
add("session_groups", lambda w: W.session_groups(w.projections.sessions, w.dataset.life_kills, now()),
    """SELECT life_id, CASE WHEN max(o) > min(o) THEN 'session-group' ELSE 'session' END AS kind,
         min(o) AS first, max(o) AS last, arg_min(connected_at, o) AS "at" FROM g GROUP BY life_id, island, scored""",
    extra=f"""so AS (SELECT s.life_id, s.connected_at,
        row_number() OVER (PARTITION BY s.life_id ORDER BY s.connected_at, s.id) AS o,
        EXISTS (SELECT 1 FROM life_kills k WHERE k.life_id = s.life_id AND k.occurred_at >= s.connected_at
                AND k.occurred_at <= coalesce(s.disconnected_at, {NOW})) AS scored FROM sessions s),
      g AS (SELECT *, sum(CASE WHEN scored THEN 1 ELSE 0 END) OVER (PARTITION BY life_id ORDER BY o) AS island
            FROM so WHERE o >= 2)""")
add("played_seconds_at",
    lambda w: W.played_seconds_at(
        w.dataset.life_kills.select("life_id", "victim_life_id", F.col("occurred_at").alias("at")),
        w.projections.sessions, w.dataset.last_seen).select("life_id", "victim_life_id", "played_seconds"),
    f"""SELECT k.life_id, k.victim_life_id, CAST(coalesce((SELECT sum(CASE
            WHEN k.occurred_at >= coalesce(s.disconnected_at, s.last_seen_at) THEN s.share
            ELSE {seconds('s.connected_at', 'k.occurred_at')} END)
          FROM sess_share s WHERE s.life_id = k.life_id AND k.occurred_at > s.connected_at), 0) AS BIGINT)
          AS played_seconds FROM life_kills k""")
add("killstreaks", lambda w: W.killstreaks(w.projections.lives, w.projections.players, w.dataset.label_kills),
    """SELECT server_id, gamertag, max(n) AS value FROM (
         SELECT l.server_id, l.gamertag, l.id, count(*) AS n FROM named l JOIN label_kills k ON k.life_id = l.id
         GROUP BY ALL) GROUP BY ALL""")
add("running_balance", lambda w: W.running_balance(w.ledger).select("id", "user_id", "balance", "overdraft"),
    """SELECT id, user_id, CAST(bal AS BIGINT) AS balance, delta < 0 AND bal - delta < 1 AS overdraft FROM (
         SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY id) AS bal FROM ledger)""")
add("newest_life",
    lambda w: latest_by(w.projections.lives.select("server_id", "player_id", "id", "life_number"),
                        ["server_id", "player_id"], [F.col("life_number")]),
    """SELECT server_id, player_id, id, life_number FROM lives
       QUALIFY row_number() OVER (PARTITION BY server_id, player_id ORDER BY life_number DESC) = 1""")
add("recent_prose", lambda w: TX.recent_prose(w.prose.withColumn("headline", F.col("lang")), "src1", 12)
    .select("id", "headline", "attribution"),
    """SELECT id, lang AS headline, kind AS attribution FROM prose WHERE kind = 'src1' AND status = 'published'
       ORDER BY created_at DESC, id DESC LIMIT 12""")

# --- paging, sets ---------------------------------------------------------------------------

add("page_with_total",
    lambda w: T.page(w.prose.where(F.col("status") == "published").select("id", "kind", "created_at"),
                     [F.col("created_at").desc(), F.col("id").desc()], 3, 20),
    """SELECT id, kind, created_at, (SELECT count(*) FROM prose WHERE status = 'published') AS total
       FROM prose WHERE status = 'published' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""")
add("order_servers", lambda w: T.order_servers(w.servers).select("id", "name"),
    "SELECT id, name FROM servers WHERE active")
add("new_notifications",
    lambda w: U.new_notifications(
        [w.notifications.where(F.col("kind") == k).select("natural_key", "user_id", "kind")
         for k in ("view", "click", "signup", "error")],
        w.notifications.where(F.col("kind") == "click").select("natural_key")),
    """SELECT natural_key, user_id, kind FROM notifications WHERE kind IN ('view', 'signup', 'error')
       GROUP BY ALL""")
add("append_new",
    lambda w: S.append_new(
        w.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        w.raw("lineitem").where(F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber"),
        ["l_orderkey", "l_linenumber"], "l_quantity"),
    """SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem l
       WHERE NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'A' AND a.l_orderkey = l.l_orderkey
         AND a.l_linenumber = l.l_linenumber) GROUP BY ALL""", base=False)
add("events_after_cursor", lambda w: S.events_after(w.events.select("event_id", "server_id"), 1234, 500),
    "SELECT event_id, server_id FROM ev WHERE event_id > 1234 ORDER BY event_id LIMIT 500")
VARIANTS = """variants AS (SELECT * FROM claims UNION ALL
    SELECT id, user_id, upper(gamertag), CASE WHEN id % 6 = 0 THEN 'verified' ELSE status END FROM claims WHERE id % 3 = 0)"""
add("label_collisions",
    lambda w: S.label_collisions(*[w.case_variants] * 2),
    """SELECT * FROM (
         SELECT 'players' AS source, CAST(NULL AS VARCHAR) AS user_id, lower(gamertag) AS label, count(*) AS copies
         FROM variants GROUP BY ALL UNION ALL
         SELECT 'verified links', NULL, lower(gamertag), count(*) FROM variants WHERE status = 'verified' GROUP BY ALL
         UNION ALL SELECT 'links of one user', user_id, lower(gamertag), count(*) FROM variants GROUP BY ALL)
       WHERE copies > 1""",
    extra=VARIANTS)
add("canonicalize_labels", lambda w: S.canonicalize_labels(w.links, w.projections.players),
    """SELECT l.id, l.user_id, l.gamertag, p.gamertag AS canonical FROM links l
       JOIN players p ON lower(p.gamertag) = lower(l.gamertag) WHERE l.gamertag <> p.gamertag""")

# --- scalar functions -----------------------------------------------------------------------

add("slugs", lambda w: w.prose.select("id", X.slug(F.col("text")).alias("slug"),
        X.obituary_slug(F.col("text"), F.col("kind"), F.lit(1), F.lit(2)).alias("address")),
    """SELECT id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
         CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'obituary'
           ELSE rtrim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-')
         END || '-' || kind || '-1-2' AS address FROM prose""")
add("durations",
    lambda w: w.projections.sessions.where(F.col("duration_seconds").isNotNull()).select(
        "id", X.time_alive_label(F.col("duration_seconds")).alias("alive"),
        X.board_duration(F.col("duration_seconds")).alias("board"),
        X.elapsed_label(F.col("duration_seconds")).alias("elapsed")),
    """SELECT id,
         CASE WHEN s >= 86400 THEN (s // 86400) || 'd' || CASE WHEN s % 86400 // 3600 > 0
                THEN ' ' || (s % 86400 // 3600) || 'h' ELSE '' END
              WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm' END AS alive,
         CASE WHEN s < 60 THEN s || 's' ELSE trim(
           CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END ||
           CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h ' ELSE '' END ||
           CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' ELSE '' END) END AS board,
         (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' AS elapsed
       FROM (SELECT id, duration_seconds AS s FROM sess WHERE duration_seconds IS NOT NULL)""")
add("labels_and_dates",
    lambda w: w.named_lives.where(F.col("ended_at").isNotNull()).select(
        "id", X.cause_label(F.col("death_cause")).alias("cause"), X.cause_family(F.col("death_cause")).alias("family"),
        X.is_melee(F.col("death_weapon")).alias("melee"), X.relative_date(F.col("ended_at"), now()).alias("ago"),
        X.month_key(F.col("ended_at")).alias("month"), X.month_year(F.col("ended_at")).alias("month_year"),
        X.vitals_line(F.col("energy_at_death"), F.col("water_at_death"), F.col("bleed_sources_at_death")).alias("vitals")),
    f"""SELECT id, CASE death_cause WHEN 'pvp' THEN 'Killed' WHEN 'died' THEN 'Unknown' WHEN 'bled_out' THEN 'Bled Out'
           ELSE upper(death_cause[1]) || death_cause[2:] END AS cause,
         CASE WHEN death_cause = 'wolf' THEN 'animal' ELSE death_cause END AS family,
         coalesce(death_weapon = 'Hunting Knife', false) AS melee,
         CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago'
              WHEN d < 30 THEN (d // 7) || CASE WHEN d // 7 > 1 THEN ' weeks ago' ELSE ' week ago' END
              ELSE (d // 30) || CASE WHEN d // 30 > 1 THEN ' months ago' ELSE ' month ago' END END AS ago,
         strftime(ended_at, '%Y-%m') AS month, strftime(ended_at, '%b %Y') AS month_year,
         CASE WHEN energy_at_death IS NULL THEN NULL ELSE 'Energy ' || CAST(energy_at_death AS INTEGER) || ' · Water '
           || CAST(water_at_death AS INTEGER) || CASE WHEN bleed_sources_at_death > 0
              THEN ' · bleeding ×' || bleed_sources_at_death ELSE '' END END AS vitals
       FROM (SELECT *, ((epoch_us({NOW}) // 1000) - (epoch_us(ended_at) // 1000)) // 86400000 AS d FROM named WHERE ended_at IS NOT NULL)""")
add("map_points",
    lambda w: w.projections.positions.select(
        "event_id", X.grid_ref(F.col("x"), F.col("y")).alias("cell"),
        X.is_far(F.col("x"), F.col("y"), F.lit(3000.0), F.lit(4000.0), 5000.0).alias("far"),
        X.world_to_pixel(F.col("x"), F.col("y"), F.lit(15360), F.lit(7680)).getField("py").alias("py"),
        X.world_to_latlng(F.col("x"), F.col("y"), F.lit(15360), F.lit(7680), F.lit(4)).getField("lng").alias("lng")),
    """SELECT event_id,
         CASE WHEN x < 100000 THEN lpad(CAST(CAST(floor(x / 100) AS INTEGER) AS VARCHAR), 3, '0')
              ELSE CAST(CAST(floor(x / 100) AS INTEGER) AS VARCHAR) END
           || ' ' || lpad(CAST(CAST(floor(y / 100) AS INTEGER) AS VARCHAR), 3, '0') AS cell,
         sqrt((x - 3000) * (x - 3000) + (y - 4000) * (y - 4000)) >= 5000 AS far,
         (15360 - y) * 0.5 AS py, x * 0.5 / 16.0 AS lng FROM fixes""")
add("distance_labels",
    lambda w: w.projections.kills.select(
        "victim_life_id", X.distance_label(F.col("distance")).alias("near"),
        X.board_value_label(F.lit("most-kills"), F.col("distance")).alias("plain")),
    """SELECT victim_life_id, CASE WHEN distance >= 1000 THEN printf('%.2f km', distance / 1000)
         ELSE CAST(floor(distance + 0.5) AS BIGINT) || ' m' END AS near,
         CAST(CAST(trunc(distance) AS BIGINT) AS VARCHAR) AS plain FROM kills""")
add("entity_and_fire",
    lambda w: w.projections.hit_events.groupBy(
        X.entity_class(F.col("attacker_label")).alias("entity"), X.is_fire(F.col("attacker_label")).alias("fire"))
    .agg(F.count("*").alias("n")),
    """SELECT CASE WHEN attacker_label LIKE 'Animal_Canis%' THEN 'wolf' WHEN attacker_label LIKE 'Animal_Ursus%' THEN 'bear' END AS entity,
         coalesce(attacker_label = 'FireplaceBase', false) AS fire, count(*) AS n FROM hits GROUP BY ALL""")
add("first_sentences",
    lambda w: w.raw("documents").select("doc_id", F.length(X.first_sentence(F.col("text"), 10_000_000)).alias("n")),
    r"""SELECT doc_id, CAST(length(CASE WHEN s = '' THEN b ELSE s END) AS INTEGER) AS n FROM (
         SELECT doc_id, b, regexp_extract(b, '^((?s).*?[.!?])(?:[\s\x0B]|$)', 1) AS s FROM (
           SELECT doc_id, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS b FROM documents))""", base=False)
add("rosters",
    lambda w: w.projections.kills.select("victim_life_id", F.array_join(X.dedupe_roster(
        F.array(F.col("killer_gamertag"), F.lower("killer_gamertag"), F.lit(" "), F.col("victim_gamertag")), 3), ",").alias("names")),
    """SELECT victim_life_id, array_to_string(list_filter([killer_gamertag, victim_gamertag], lambda x: length(x) >= 3), ',')
         AS names FROM kills""")
add("ban_names", lambda w: w.bans.select("id", F.array_join(X.ban_names(F.col("dayz_id"), F.col("gamertag")), ",").alias("names")),
    "SELECT id, dayz_id || ',' || gamertag AS names FROM bans")
add("composed_tags",
    lambda w: w.articles.select("id", F.array_join(X.compose_tags(
        F.col("map"), F.when(F.col("cause") == "pvp", "pvp").otherwise("unknown"),
        F.array(F.lit("obituaries"), F.lit(" "), F.col("cause"))), ",").alias("tags")),
    """SELECT id, 'Obituaries,' || CASE map WHEN 'chernarusplus' THEN 'Chernarus' WHEN 'sakhal' THEN 'Sakhal' ELSE 'Livonia' END
         || ',' || CASE WHEN cause = 'pvp' THEN 'PvP' ELSE 'Unknown,' || cause END AS tags FROM articles""")
add("article_facts",
    lambda w: articles.obituary(w.articles).select(
        "slug", F.col("facts.sessions").alias("sessions"), F.col("facts.killer_gamertag").alias("killer"),
        F.col("facts.verdict.confidence").alias("confidence"), F.col("facts.verdict.cause").alias("verdict")),
    """SELECT slug, life_number AS sessions, death_by_gamertag AS killer,
         CASE WHEN id % 2 = 0 THEN 'high' END AS confidence, CASE WHEN id % 2 = 0 THEN cause END AS verdict
       FROM articles WHERE status = 'published' AND gamertag IS NOT NULL""")
add("verdict_phrases",
    lambda w: w.dataset.verdicts.where(F.col("ended_at").isNotNull()).select(
        "life_id", X.verdict_phrase(F.col("verdict.cause"), F.col("verdict.confidence"), F.col("verdict.conditions"),
                                    F.col("death_cause")).alias("phrase")),
    """SELECT id AS life_id, CASE
         WHEN verdict_cause = 'pvp' THEN 'Killed' WHEN verdict_cause = 'wolf' THEN 'Wolf' WHEN verdict_cause = 'fall' THEN 'Fell'
         WHEN verdict_cause = 'environmental' THEN 'Environment' WHEN verdict_cause = 'unknown' THEN 'Unknown'
         WHEN verdict_cause = 'suicide' THEN CASE WHEN verdict_conditions = 'healthy' THEN 'Suicide (in good health)'
           ELSE 'Suicide (' || replace(verdict_conditions, ',', ', ') || ')' END
         ELSE CASE WHEN verdict_confidence = 'low' THEN 'Likely ' ELSE '' END || CASE verdict_cause
           WHEN 'starvation' THEN CASE WHEN verdict_confidence = 'low' THEN 'starvation' ELSE 'Starvation' END
           WHEN 'dehydration' THEN CASE WHEN verdict_confidence = 'low' THEN 'dehydration' ELSE 'Dehydration' END
           WHEN 'mauled' THEN 'Mauled' ELSE 'Bled out' END END AS phrase
       FROM verdicts WHERE ended_at IS NOT NULL""")

# --- boards ---------------------------------------------------------------------------------

SURVIVORS_SQL = """SELECT s.player_id, s.gamertag, v.map, v.slug, CAST(s.seconds AS BIGINT) AS time_alive_seconds,
    s.kills AS kills_this_life, s.longest_kill_meters FROM status s JOIN live v ON v.id = s.server_id
    WHERE s.ended_at IS NULL AND s.qualified"""
add("survivors_board", lambda w: boards.survivors(w.dataset, 2),
    f"""SELECT c.*, (SELECT count(*) FROM c) AS total, a.hash AS avatar_hash FROM c
        LEFT JOIN links l ON lower(l.gamertag) = lower(c.gamertag) AND l.status = 'verified'
        LEFT JOIN avatars a ON a.user_id = l.user_id
        ORDER BY time_alive_seconds DESC, kills_this_life DESC, longest_kill_meters DESC NULLS LAST, gamertag, slug
        LIMIT 25 OFFSET 25""", extra=f"c AS ({SURVIVORS_SQL})")
add("board_most_kills", lambda w: boards.board_most_kills(w.dataset, 10),
    """SELECT server_id, killer_gamertag AS gamertag, count(*) AS value, CAST(row_number() OVER (
         PARTITION BY server_id ORDER BY count(*) DESC, killer_gamertag) AS INTEGER) AS rank
       FROM kills GROUP BY server_id, killer_gamertag QUALIFY rank <= 10""")
add("board_longest_kills", lambda w: boards.board_longest_kills(w.dataset, 10),
    """SELECT server_id, killer_gamertag AS gamertag, distance AS value, victim_gamertag AS victim, weapon,
         CAST(row_number() OVER (PARTITION BY server_id ORDER BY distance DESC, occurred_at) AS INTEGER) AS rank
       FROM kills QUALIFY rank <= 10""")
add("board_alltime_longest", lambda w: boards.board_alltime_longest(w.dataset, 10),
    f"""SELECT server_id, gamertag, max(playtime_seconds) AS value, CAST(row_number() OVER (PARTITION BY server_id
          ORDER BY max(playtime_seconds) DESC, gamertag) AS INTEGER) AS rank
        FROM named WHERE death_cause = 'pvp' OR playtime_seconds >= {QUALIFY}
          OR id IN (SELECT life_id FROM label_kills) GROUP BY server_id, gamertag QUALIFY rank <= 10""")
add("board_alive_longest", lambda w: boards.board_alive_longest(w.dataset, 10),
    f"""SELECT server_id, gamertag, CAST(seconds AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY server_id
          ORDER BY seconds DESC, gamertag) AS INTEGER) AS rank
        FROM status s WHERE ended_at IS NULL AND (seconds >= {QUALIFY} OR EXISTS (SELECT 1 FROM label_kills k
          WHERE k.life_id = s.id AND k.occurred_at <= s.up_to)) QUALIFY rank <= 10""")
add("board_longest_killstreak", lambda w: boards.board_killstreak(w.dataset, 10),
    """SELECT server_id, gamertag, max(n) AS value, CAST(row_number() OVER (PARTITION BY server_id
         ORDER BY max(n) DESC, gamertag) AS INTEGER) AS rank FROM (
         SELECT l.server_id, l.gamertag, l.id, count(*) AS n FROM named l JOIN label_kills k ON k.life_id = l.id
         WHERE k.killer_player_id IS NOT NULL GROUP BY ALL) GROUP BY server_id, gamertag QUALIFY rank <= 10""")
add("global_board_most_kills",
    lambda w: boards.global_board(w.dataset, boards.board_most_kills(w.dataset, 12), 12),
    """SELECT k.server_id, k.killer_gamertag AS gamertag, count(*) AS value, v.map, v.slug
       FROM kills k JOIN live v ON v.id = k.server_id GROUP BY ALL ORDER BY value DESC, gamertag, slug LIMIT 12""")
add("kill_feed", lambda w: boards.feed(w.projections.kills, 30, 10).select("event_id", "killer_gamertag", "occurred_at"),
    "SELECT event_id, killer_gamertag, occurred_at FROM kills ORDER BY occurred_at DESC, event_id DESC LIMIT 30 OFFSET 10")
add("build_feed", lambda w: boards.feed(w.projections.build_events, 20, 0, "P3").select("event_id", "object", "occurred_at"),
    "SELECT event_id, object, occurred_at FROM builds WHERE gamertag = 'P3' ORDER BY occurred_at DESC, event_id DESC LIMIT 20")
ROSTER_SQL = f"""SELECT n.server_id, n.gamertag, n.player_id,
      CAST({seconds('o.connected_at', 'n.last_seen_at')} AS BIGINT) AS session_seconds,
      CAST(n.playtime_seconds + {seconds('o.connected_at', 'n.last_seen_at')} AS BIGINT) AS life_seconds
    FROM named n JOIN open_sess o USING (id)"""
add("roster", lambda w: boards.roster(w.dataset), ROSTER_SQL)
add("global_roster", lambda w: boards.global_roster(w.dataset),
    f"SELECT x.*, v.map, v.slug FROM ({ROSTER_SQL}) x JOIN live v ON v.id = x.server_id")
add("site_stats", lambda w: boards.site_stats(w.dataset),
    f"SELECT (SELECT count(ended_at) FROM lives) AS deaths, (SELECT count(*) FROM ({SURVIVORS_SQL})) AS alive")

# --- players --------------------------------------------------------------------------------

PROFILE_SQL = """SELECT server_id, player_id, gamertag, last_seen_at, count(*) FILTER (WHERE qualified) AS lives,
      count(*) FILTER (WHERE qualified AND ended_at IS NOT NULL) AS deaths,
      CAST(coalesce(sum(seconds) FILTER (WHERE qualified), 0) AS BIGINT) AS total_playtime_seconds,
      CAST(coalesce(max(seconds) FILTER (WHERE qualified AND ended_at IS NULL), 0) AS BIGINT) AS current_life_seconds,
      coalesce(bool_or(qualified AND ended_at IS NULL), false) AS alive,
      coalesce(max(playtime_seconds) FILTER (WHERE qualified), 0) AS longest_life_seconds
    FROM status GROUP BY ALL"""
add("profiles", lambda w: players.profiles(w.dataset), PROFILE_SQL)
add("player_lives", lambda w: players.player_lives(w.dataset).select("id", "server_id", "player_id", "life_number"),
    "SELECT id, server_id, player_id, life_number FROM status WHERE qualified")
add("life_detail",
    lambda w: players.life_detail(w.dataset).select("id", "gamertag", "session_id", "connected_at", "close_reason"),
    """SELECT n.id, n.gamertag, s.id AS session_id, s.connected_at, s.close_reason
       FROM named n LEFT JOIN sessions s ON s.life_id = n.id""")
add("player_aggregate",
    lambda w: players.player_aggregate(w.dataset),
    f"""SELECT p.player_id, CAST(sum(p.lives) AS BIGINT) AS lives, CAST(sum(p.deaths) AS BIGINT) AS deaths,
          CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS kills, CAST(sum(p.total_playtime_seconds) AS BIGINT) AS total_playtime_seconds,
          max(p.longest_life_seconds) AS longest_life_seconds, bool_or(p.alive) AS alive_anywhere, p.gamertag
        FROM ({PROFILE_SQL}) p JOIN live v ON v.id = p.server_id
        LEFT JOIN (SELECT server_id, killer_player_id, count(*) AS n FROM kills GROUP BY ALL) k
          ON k.server_id = p.server_id AND k.killer_player_id = p.player_id
        GROUP BY p.player_id, p.gamertag""")
STANDING = """abans AS (
  SELECT b.*, p.player_id FROM bans b JOIN players p USING (gamertag)
  WHERE b.status IN ('applied', 'pending', 'lift_pending') AND NOT b.dry_run
  QUALIFY row_number() OVER (PARTITION BY b.server_id, p.player_id ORDER BY b.id) = 1),
opens AS (SELECT * FROM status WHERE ended_at IS NULL),
recent AS (SELECT server_id, player_id, max(life_number) AS life_number, arg_max(ended_at, life_number) AS ended_at
  FROM status WHERE qualified GROUP BY ALL),
standing AS (
  SELECT k.server_id, k.player_id, p.gamertag, v.map, v.slug,
    CASE WHEN b.id IS NOT NULL THEN 'banned' WHEN o.id IS NOT NULL THEN 'alive' ELSE 'idle' END AS state,
    CASE WHEN b.id IS NULL AND o.id IS NOT NULL THEN CAST(o.seconds AS BIGINT) END AS time_alive_seconds,
    CASE WHEN b.id IS NULL AND o.id IS NOT NULL THEN q.qualified_at END AS qualified_at,
    b.id AS ban_id, trig.life_number AS triggering_life_number, tv.verdict_cause AS ban_cause,
    CASE WHEN b.id IS NOT NULL THEN trig.life_number WHEN o.id IS NOT NULL THEN o.life_number ELSE rc.life_number END
      AS last_life_number,
    CASE WHEN b.id IS NULL AND o.id IS NULL THEN rc.ended_at END AS last_ended_at
  FROM (SELECT DISTINCT server_id, player_id FROM status) k
  JOIN live v ON v.id = k.server_id JOIN players p USING (player_id)
  LEFT JOIN abans b ON b.server_id = k.server_id AND b.player_id = k.player_id
  LEFT JOIN status trig ON trig.qualified AND trig.server_id = k.server_id AND trig.player_id = k.player_id
    AND trig.started_at = b.life_started_at
  LEFT JOIN verdicts tv ON tv.id = trig.id
  LEFT JOIN opens o ON o.server_id = k.server_id AND o.player_id = k.player_id
  LEFT JOIN qat q ON q.life_id = o.id
  LEFT JOIN recent rc ON rc.server_id = k.server_id AND rc.player_id = k.player_id)"""
add("standings",
    lambda w: players.standings(w.dataset).select(
        "server_id", "player_id", "gamertag", "map", "slug", "state", "time_alive_seconds", "qualified_at", "ban_id",
        "triggering_life_number", "ban_cause", "last_life_number", "last_ended_at"),
    "SELECT * FROM standing", extra=STANDING)
add("server_cards",
    lambda w: players.server_cards(w.dataset, w.projections.players.select(F.col("id").alias("player_id")))[0]
    .select("player_id", "slug", "state", "last_life_number"),
    """SELECT p.player_id, v.slug, s.state, s.last_life_number
       FROM players p JOIN standing s ON s.player_id = p.player_id JOIN live v ON s.server_id = v.id""",
    extra=STANDING)
add("player_page_head",
    lambda w: players.page_totals(w.dataset),
    """SELECT s.player_id, s.gamertag, s.first_seen_at, count(*) FILTER (WHERE s.qualified) AS lives,
         count(*) FILTER (WHERE s.qualified AND s.ended_at IS NOT NULL) AS deaths,
         CAST(coalesce(max(s.seconds) FILTER (WHERE s.qualified), 0) AS BIGINT) AS longest_life_seconds,
         coalesce(max(s.playtime_seconds) FILTER (WHERE s.qualified AND s.ended_at IS NOT NULL), 0) AS previous_best_seconds,
         (SELECT count(*) FROM kills k JOIN live v2 ON v2.id = k.server_id WHERE k.killer_player_id = s.player_id) AS kills,
         coalesce((SELECT bool_or(t.qualified_at IS NOT NULL) FROM standing t WHERE t.player_id = s.player_id AND t.state = 'alive'), false)
           AS alive_anywhere,
         EXISTS (SELECT 1 FROM links l WHERE l.status = 'verified' AND lower(l.gamertag) = lower(s.gamertag)) AS verified
       FROM status s JOIN live v ON v.id = s.server_id GROUP BY s.player_id, s.gamertag, s.first_seen_at""",
    extra=STANDING)
add("player_past_lives",
    lambda w: players.past_lives(w.dataset, 2, 3).select(
        "player_id", "life_id", "slug", "time_alive_seconds", "kills", "verdict_cause", "session_count",
        "position", "page", "total"),
    """SELECT player_id, id AS life_id, slug, playtime_seconds AS time_alive_seconds, kills, verdict_cause, session_count,
         CAST(pos AS BIGINT) AS position, CAST(pg AS BIGINT) AS page, total FROM (
         SELECT s.player_id, s.id, v.slug, s.playtime_seconds, s.kills, x.verdict_cause,
           (SELECT count(*) FROM sessions z WHERE z.life_id = s.id) AS session_count,
           row_number() OVER (PARTITION BY s.player_id ORDER BY s.ended_at DESC, s.id DESC) AS pos,
           count(*) OVER (PARTITION BY s.player_id) AS total,
           least(2, greatest(1, ceil(count(*) OVER (PARTITION BY s.player_id) / 3.0))) AS pg
         FROM status s JOIN live v ON v.id = s.server_id JOIN verdicts x ON x.id = s.id
         WHERE s.qualified AND s.ended_at IS NOT NULL)
       WHERE pos > (pg - 1) * 3 AND pos <= pg * 3""")
add("player_priors",
    lambda w: w.dataset.priors.drop("usual_death_cause"),
    """SELECT n.id AS life_id, n.player_id, count(p.id) AS lives_lived, coalesce(max(p.playtime_seconds), 0) AS longest_life_seconds,
         (SELECT count(*) FROM kills k WHERE k.killer_player_id = n.player_id AND k.occurred_at < n.started_at) AS total_kills,
         arg_max(p.death_cause, p.ended_at) FILTER (WHERE p.ended_at IS NOT NULL) AS last_death_cause,
         arg_max(s.map, struct_pack(a := p.playtime_seconds, b := -p.id)) FILTER (WHERE p.playtime_seconds > 0) AS best_life_map
       FROM lives n LEFT JOIN lives p ON p.player_id = n.player_id AND p.started_at < n.started_at
       LEFT JOIN servers s ON s.id = p.server_id GROUP BY n.id, n.player_id, n.started_at""")

# --- lives ----------------------------------------------------------------------------------

add("life_dossier",
    lambda w: lives.life_dossier(w.dataset).select(
        "life_id", "recent_hits", "recent_infected_hits", "infected_hp_low", "fatal_falls", "recent_knockouts"),
    """SELECT id AS life_id, recent_hits, recent_infected_hits, infected_hp_low, fatal_falls, recent_knockouts FROM facts""")
add("death_verdicts",
    lambda w: w.dataset.verdicts.select(
        "life_id", F.col("verdict.cause").alias("cause"), F.col("verdict.confidence").alias("confidence"),
        F.array_join("verdict.conditions", ",").alias("conditions")),
    """SELECT id AS life_id, verdict_cause AS cause, verdict_confidence AS confidence, verdict_conditions AS conditions
       FROM verdicts""")
add("life_timeline",
    lambda w: lives.life_timeline(w.dataset).select(
        "life_id", "gamertag", "kills", "qualified_at", "qualified_by", "encounter_count", "obituary_slug",
        F.col("verdict.cause").alias("cause"), "pvp_hits"),
    """SELECT v.id AS life_id, s.gamertag, s.kills, q.qualified_at, q.qualified_by,
         (SELECT count(*) FROM encounters e2 WHERE e2.life_id = v.id) AS encounter_count,
         (SELECT min(a.slug) FROM articles a WHERE a.status = 'published' AND a.server_id = s.server_id
            AND lower(a.gamertag) = lower(s.gamertag) AND a.life_started_at = s.started_at) AS obituary_slug,
         v.verdict_cause AS cause,
         CASE WHEN v.ended_at IS NOT NULL THEN coalesce((SELECT o.hits FROM ordeals o WHERE o.life_id = v.id AND o.ordeal = 'pvp'), 0) END
           AS pvp_hits
       FROM verdicts v JOIN status s USING (id) LEFT JOIN qat q ON q.life_id = v.id""")
_PLURAL = "hits || CASE WHEN hits = 1 THEN ' {0}' ELSE ' {0}s' END"
_HP = "CAST(CAST(floor(hp_low + 0.5) AS BIGINT) AS VARCHAR)"
add("timeline_events",
    lambda w: lives.timeline_events(w.dataset).select(
        "life_id", "kind", "at", "time_label", "title", "line", "name", "distance", "weapon", "verdict"),
    f"""SELECT life_id, kind, tm AS "at", coalesce(fixed, (CAST(p // 3600 AS BIGINT)) || 'h '
          || lpad(CAST(CAST(p % 3600 // 60 AS BIGINT) AS VARCHAR), 2, '0') || 'm in') AS time_label, title, line, name, distance, weapon, verdict
        FROM (SELECT t.*, coalesce((SELECT sum(CASE WHEN t.tm >= coalesce(s.disconnected_at, s.last_seen_at) THEN s.share
                 ELSE {seconds('s.connected_at', 't.tm')} END)
               FROM sess_share s WHERE s.life_id = t.life_id AND t.tm > s.connected_at), 0) AS p FROM te t)""",
    extra=f"""so AS (SELECT s.life_id, s.connected_at,
        row_number() OVER (PARTITION BY s.life_id ORDER BY s.connected_at, s.id) AS o,
        EXISTS (SELECT 1 FROM life_kills k WHERE k.life_id = s.life_id AND k.occurred_at >= s.connected_at
                AND k.occurred_at <= coalesce(s.disconnected_at, {NOW})) AS scored FROM sessions s),
      g AS (SELECT *, sum(CASE WHEN scored THEN 1 ELSE 0 END) OVER (PARTITION BY life_id ORDER BY o) AS island
            FROM so WHERE o >= 2),
      te_runs AS (SELECT life_id, min(o) AS a, max(o) AS z, arg_min(connected_at, o) AS tm FROM g GROUP BY life_id, island, scored),
      far AS (SELECT life_id, arg_max(victim_life_id, (distance, -epoch_us(occurred_at), -victim_life_id)) AS longest
              FROM life_kills WHERE distance IS NOT NULL GROUP BY 1),
      te AS (
      SELECT id AS life_id, 'birth' AS kind, started_at AS tm, '0h 00m' AS fixed, CAST(NULL AS VARCHAR) AS name,
        'Washed ashore — life begins' AS title, 'Session 1. Grace period active.' AS line, CAST(NULL AS DOUBLE) AS distance,
        CAST(NULL AS VARCHAR) AS weapon, CAST(NULL AS VARCHAR) AS verdict FROM lives
      UNION ALL SELECT life_id, 'qualified', qualified_at, NULL, NULL, 'Life qualified', CASE qualified_by
          WHEN 'kill' THEN 'First blood drawn. The life counts from here.'
          WHEN 'pvp-death' THEN 'Qualified at the moment of death — killed by a player.'
          ELSE 'Five minutes survived. The grace period ends; from here, death counts.' END, NULL, NULL, NULL FROM qat
      UNION ALL SELECT life_id, CASE WHEN z > a THEN 'session-group' ELSE 'session' END, tm, NULL, NULL,
        CASE WHEN z > a THEN 'Sessions ' || a || '–' || z ELSE 'Session ' || a || ' began' END,
        CASE WHEN z > a THEN (z - a + 1) || ' logins' ELSE 'Logged in.' END, NULL, NULL, NULL FROM te_runs
      UNION ALL SELECT k.life_id, 'kill', occurred_at, NULL, victim_gamertag, weapon,
        CASE WHEN k.victim_life_id = f.longest THEN 'longest kill' END, distance, weapon, NULL FROM life_kills k LEFT JOIN far f USING (life_id)
      UNION ALL SELECT life_id, 'encounter', started_at, NULL, attacker_gamertag,
        CASE category WHEN 'fire' THEN 'Burned — ' || {_PLURAL.format("blow")} WHEN 'player' THEN 'Firefight'
          WHEN 'bear' THEN 'A bear — fought off' WHEN 'wolf' THEN CASE WHEN hits >= 3 THEN 'Wolves — fought off' ELSE 'A wolf — fought off' END
          WHEN 'infected' THEN CASE WHEN hits >= 3 THEN 'Horde — ' || hits || ' blows over ' || minutes ELSE 'Infected — ' || {_PLURAL.format("blow")} END
          ELSE 'Took a beating — ' || {_PLURAL.format("hit")} END,
        CASE WHEN category IN ('bear', 'wolf') THEN {_PLURAL.format("blow")} || ' over ' || minutes || coalesce(' · HP down to ' || {_HP}, '') ELSE
        CASE category WHEN 'fire' THEN coalesce('HP down to ' || {_HP}, 'Got clear of the flames')
          WHEN 'player' THEN {_PLURAL.format("hit")} || ' taken' || coalesce(' · HP ' || {_HP}, '')
          WHEN 'infected' THEN coalesce('HP down to ' || {_HP}, CASE WHEN hits >= 3 THEN 'Fought clear' ELSE {_PLURAL.format("blow")} END)
          ELSE coalesce('HP down to ' || {_HP}, 'Walked it off') END END, NULL, NULL, NULL
        FROM (SELECT *, greatest(1, CAST(floor(duration_seconds / 60.0 + 0.5) AS BIGINT)) || 'm' AS minutes FROM encounters)
      UNION ALL SELECT id, 'now', {NOW}, 'NOW', NULL, 'Still drawing breath', CASE WHEN s < 60 THEN s || 's' ELSE trim(
           CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END ||
           CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h ' ELSE '' END ||
           CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' ELSE '' END) END, NULL, NULL, NULL
        FROM (SELECT l.id, CAST(sum(h.share) AS BIGINT) AS s FROM lives l JOIN sess_share h ON h.life_id = l.id WHERE l.ended_at IS NULL GROUP BY l.id)
      UNION ALL SELECT l.id, 'death', l.ended_at, (l.playtime_seconds // 3600) || 'h '
        || lpad(CAST(l.playtime_seconds % 3600 // 60 AS VARCHAR), 2, '0') || 'm in', l.death_by_gamertag, l.death_cause,
        CASE WHEN l.energy_at_death IS NULL THEN NULL ELSE 'Energy ' || CAST(l.energy_at_death AS INTEGER) || ' · Water '
           || CAST(l.water_at_death AS INTEGER) || CASE WHEN l.bleed_sources_at_death > 0
             THEN ' · bleeding ×' || l.bleed_sources_at_death ELSE '' END END, l.death_distance, l.death_weapon, v.verdict_cause
        FROM lives l LEFT JOIN verdicts v ON v.id = l.id WHERE l.ended_at IS NOT NULL)""")
LIFE_FIX = """lfix AS (SELECT n.id AS life_id, f.* FROM fixes f JOIN named n ON n.server_id = f.server_id
  AND n.player_id = f.player_id AND f.recorded_at >= n.started_at
  AND f.recorded_at <= coalesce(n.ended_at, n.last_seen_at, n.started_at))"""
THIN = """, nums AS (SELECT *, row_number() OVER (PARTITION BY life_id ORDER BY recorded_at, event_id) AS rn,
        count(*) OVER (PARTITION BY life_id) AS n FROM lfix),
      per AS (SELECT life_id, list(struct_pack(e := event_id, x := x, y := y) ORDER BY rn) AS pts FROM nums GROUP BY life_id),
      folded AS (SELECT life_id, list_reduce(list_transform(pts, lambda p: struct_pack(ids := [p.e], x := p.x, y := p.y)),
        lambda acc, p: CASE WHEN sqrt((p.x - acc.x) * (p.x - acc.x) + (p.y - acc.y) * (p.y - acc.y)) >= 15
           THEN struct_pack(ids := list_concat(acc.ids, p.ids), x := p.x, y := p.y) ELSE acc END) AS k FROM per),
      thin AS (SELECT u.* FROM nums u JOIN folded f ON f.life_id = u.life_id
               WHERE list_contains(f.k.ids, u.event_id) OR u.rn = u.n)"""
add("life_track_points",
    lambda w: lives.life_track(w.dataset)["points"].select("life_id", "session_id", "event_id", "x", "y"),
    """SELECT t.life_id, s.id AS session_id, t.event_id, t.x, t.y FROM thin t
       JOIN sessions s ON s.life_id = t.life_id JOIN named n ON n.id = t.life_id
        AND t.recorded_at >= s.connected_at AND t.recorded_at <= coalesce(s.disconnected_at,
          greatest(coalesce(n.ended_at, n.last_seen_at, n.started_at), s.connected_at))""",
    extra=LIFE_FIX + THIN)
add("life_track_markers",
    lambda w: lives.life_track(w.dataset)["markers"].select("life_id", "kind", "at", "x", "y", "sample_age_seconds", "label"),
    f"""SELECT m.life_id, m.kind, m.tm AS "at", f.x, f.y,
          CAST(floor(((epoch_us(m.tm) // 1000) - (epoch_us(f.recorded_at) // 1000)) / 1000.0 + 0.5) AS BIGINT) AS sample_age_seconds, m.label
        FROM mk m ASOF JOIN lfix f ON f.life_id = m.life_id AND m.tm >= f.recorded_at
        WHERE floor(((epoch_us(m.tm) // 1000) - (epoch_us(f.recorded_at) // 1000)) / 1000.0 + 0.5) <= {FRESH}""",
    extra=LIFE_FIX + """, mk AS (
      SELECT k.life_id, 'kill' AS kind, k.occurred_at AS tm, k.victim_gamertag AS label FROM life_kills k
        JOIN named n ON n.id = k.life_id WHERE k.occurred_at <= coalesce(n.ended_at, n.last_seen_at, n.started_at)
      UNION ALL SELECT id, 'death', ended_at, NULL FROM lives WHERE ended_at IS NOT NULL
      UNION ALL SELECT life_id, 'now', max(recorded_at), NULL FROM lfix
        WHERE life_id IN (SELECT id FROM lives WHERE ended_at IS NULL) GROUP BY life_id)""")
add("life_track_summary", lambda w: lives.life_track(w.dataset)["summary"].select("life_id", "sample_count", "kept"),
    "SELECT u.life_id, any_value(u.n) AS sample_count, count(*) AS kept FROM thin u GROUP BY u.life_id",
    extra=LIFE_FIX + THIN)
add("obituary_facts",
    lambda w: lives.obituary_facts(w.dataset).select(
        "life_id", "gamertag", "time_alive_label", "kills", "sessions", "cause_category", "is_legend",
        "fresh_spawn_victim", "is_known_quantity"),
    """SELECT v.id AS life_id, s.gamertag,
         CASE WHEN d >= 86400 THEN (d // 86400) || 'd' || CASE WHEN d % 86400 // 3600 > 0 THEN ' ' || (d % 86400 // 3600) || 'h' ELSE '' END
              WHEN d >= 3600 THEN (d // 3600) || 'h ' || (d % 3600 // 60) || 'm' ELSE (d // 60) || 'm' END AS time_alive_label,
         s.kills, (SELECT count(*) FROM sessions z WHERE z.life_id = v.id) AS sessions, cc AS cause_category,
         s.kills >= 20 OR d >= 604800 AS is_legend, cc = 'pvp' AND d < 1800 AS fresh_spawn_victim,
         EXISTS (SELECT 1 FROM lives p WHERE p.player_id = v.player_id AND p.started_at < v.started_at) AS is_known_quantity
       FROM (SELECT *, playtime_seconds AS d, CASE WHEN death_cause = 'pvp' THEN 'pvp' WHEN death_cause = 'suicide' THEN 'suicide'
               WHEN death_cause NOT IN ('died', 'environment') OR verdict_cause NOT IN ('environmental', 'unknown') THEN 'environment'
               ELSE 'unknown' END AS cc FROM verdicts) v
       JOIN status s USING (id) WHERE v.ended_at IS NOT NULL""")

# --- maps -----------------------------------------------------------------------------------

SHARED = f"""vw AS (SELECT l.user_id, l.gamertag AS tag, p.player_id FROM links l
    LEFT JOIN players p ON lower(p.gamertag) = lower(l.gamertag) WHERE l.status = 'verified'),
  fresh AS (SELECT f.* FROM fixes f WHERE f.recorded_at >= {NOW} - to_seconds({FRESH})
     AND EXISTS (SELECT 1 FROM sessions s WHERE s.server_id = f.server_id AND s.player_id = f.player_id AND s.disconnected_at IS NULL)
     QUALIFY row_number() OVER (PARTITION BY server_id, player_id ORDER BY recorded_at DESC, event_id DESC) = 1),
  granted AS (SELECT h.grantee_user_id, h.server_id, p.player_id, l.gamertag AS tag FROM shares h
     JOIN links l ON l.user_id = h.granter_user_id AND l.status = 'verified'
     JOIN players p ON lower(p.gamertag) = lower(l.gamertag)
     JOIN sessions s ON s.player_id = p.player_id AND s.server_id = h.server_id AND s.disconnected_at IS NULL
      AND s.connected_at = h.granter_session_connected_at
     WHERE h.grantee_user_id IN (SELECT user_id FROM vw)),
  own AS (SELECT v.user_id, f.server_id, v.tag, f.x, f.y, f.recorded_at FROM vw v JOIN fresh f USING (player_id)),
  stale AS (SELECT v.user_id, f.server_id, v.tag, f.x, f.y, f.recorded_at FROM vw v
     JOIN lives l ON l.player_id = v.player_id AND l.ended_at IS NULL
     JOIN fixes f ON f.server_id = l.server_id AND f.player_id = l.player_id AND f.recorded_at >= l.started_at
     WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = v.user_id AND o.server_id = l.server_id)
     QUALIFY row_number() OVER (PARTITION BY v.user_id, f.server_id ORDER BY f.recorded_at DESC, f.event_id DESC) = 1),
  shared AS (SELECT user_id AS viewer_user_id, server_id, tag AS gamertag, x, y, recorded_at, true AS is_self FROM own
     UNION ALL SELECT user_id, server_id, tag, x, y, recorded_at, true FROM stale
     UNION ALL SELECT g.grantee_user_id, f.server_id, g.tag, f.x, f.y, f.recorded_at, false
       FROM granted g JOIN fresh f ON f.server_id = g.server_id AND f.player_id = g.player_id)"""
add("shared_positions", lambda w: maps.shared_positions(w.dataset), "SELECT * FROM shared", extra=SHARED)
add("online_players",
    lambda w: maps.online_players(w.dataset, "U7", maps.shared_positions(w.dataset)),
    f"""SELECT server_id, gamertag, is_self, sharing, CASE WHEN is_self THEN 0 WHEN sharing THEN 1 ELSE 2 END AS rank FROM (
          SELECT DISTINCT s.server_id, p.gamertag, lower(p.gamertag) = 'p7' AS is_self,
            EXISTS (SELECT 1 FROM shared h WHERE h.viewer_user_id = 'U7' AND h.server_id = s.server_id
              AND lower(h.gamertag) = lower(p.gamertag)) AS sharing
          FROM sessions s JOIN players p USING (player_id) WHERE s.disconnected_at IS NULL
            AND (s.connected_at >= {NOW} - to_seconds({FRESH}) OR EXISTS (SELECT 1 FROM fixes f
              WHERE f.server_id = s.server_id AND f.player_id = s.player_id AND f.recorded_at >= {NOW} - to_seconds({FRESH}))))""",
    extra=SHARED)
ONLINE = f""", online AS (SELECT DISTINCT s.server_id, p.gamertag FROM sessions s JOIN players p USING (player_id)
    WHERE s.disconnected_at IS NULL AND (s.connected_at >= {NOW} - to_seconds({FRESH}) OR EXISTS (SELECT 1 FROM fixes f
      WHERE f.server_id = s.server_id AND f.player_id = s.player_id AND f.recorded_at >= {NOW} - to_seconds({FRESH}))))"""
add("online_now", lambda w: maps.online_now(w.dataset).select("server_id", "gamertag").distinct(),
    "SELECT server_id, gamertag FROM online", extra=SHARED + ONLINE)
add("presence_marks",
    lambda w: maps.presence_marks(w.dataset, maps.shared_positions(w.dataset)),
    """SELECT viewer_user_id, server_id, label, bool_or(is_self) AS is_self, bool_or(sharing) AS sharing FROM (
         SELECT l.user_id AS viewer_user_id, o.server_id, lower(o.gamertag) AS label, true AS is_self, false AS sharing
         FROM links l JOIN online o ON lower(o.gamertag) = lower(l.gamertag) WHERE l.status = 'verified'
         UNION ALL SELECT h.viewer_user_id, h.server_id, lower(h.gamertag), false, true FROM shared h
           JOIN online o ON o.server_id = h.server_id AND lower(o.gamertag) = lower(h.gamertag)) GROUP BY ALL""",
    extra=SHARED + ONLINE)
LAST_PLAYED = """lp AS (SELECT l.user_id, arg_max(v.slug, s.id) AS slug FROM links l
    JOIN players p ON lower(p.gamertag) = lower(l.gamertag) JOIN sessions s USING (player_id)
    JOIN live v ON v.id = s.server_id WHERE l.status = 'verified' GROUP BY l.user_id)"""
add("last_played", lambda w: maps.last_played(w.dataset), "SELECT * FROM lp", extra=LAST_PLAYED)
add("map_destination",
    lambda w: maps.map_destination(w.dataset, w.links.select(
        "user_id", F.when(F.col("id") % 3 == 0, "sakhal").when(F.col("id") % 3 == 1, "livonia").alias("session_slug"))),
    """SELECT l.user_id, coalesce(CASE WHEN l.id % 3 = 0 THEN 'sakhal' END, lp.slug, 'chernarus') AS slug
       FROM links l LEFT JOIN lp USING (user_id)""", extra=LAST_PLAYED)
add("sharing_with", lambda w: maps.sharing_with(w.dataset),
    """SELECT h.granter_user_id, h.server_id, t.gamertag AS grantee_gamertag FROM shares h
       JOIN links l ON l.user_id = h.granter_user_id AND l.status = 'verified'
       JOIN players p ON lower(p.gamertag) = lower(l.gamertag)
       JOIN (SELECT server_id, player_id, max(connected_at) AS tm FROM sessions WHERE disconnected_at IS NULL GROUP BY ALL) s
         ON s.server_id = h.server_id AND s.player_id = p.player_id AND s.tm = h.granter_session_connected_at
       JOIN links t ON t.user_id = h.grantee_user_id AND t.status = 'verified'""")

# --- articles, accounts ---------------------------------------------------------------------

add("obituaries_feed", lambda w: articles.obituaries(w.articles, 2).select("slug", "gamertag", "map", "death_at", "total"),
    """SELECT slug, gamertag, map, death_at, (SELECT count(*) FROM articles WHERE status = 'published' AND gamertag IS NOT NULL) AS total
       FROM articles WHERE status = 'published' AND gamertag IS NOT NULL ORDER BY death_at DESC, id DESC LIMIT 20 OFFSET 20""")
add("corrupt_obituaries", lambda w: articles.published_obituaries(w.articles)[1].select("id", "slug"),
    "SELECT id, slug FROM articles WHERE status = 'published' AND gamertag IS NULL")
add("sitemap", lambda w: articles.sitemap_entries(w.dataset),
    """SELECT 'player' AS kind, gamertag AS name, CAST(NULL AS VARCHAR) AS map_slug, CAST(NULL AS INTEGER) AS life_number,
         max(coalesce(ended_at, started_at)) AS lastmod FROM named GROUP BY gamertag
       UNION ALL SELECT 'life', n.gamertag, s.slug, n.life_number, coalesce(n.ended_at, n.started_at)
         FROM named n JOIN servers s ON s.id = n.server_id
       UNION ALL SELECT kind, slug, NULL, NULL, created_at FROM articles WHERE status = 'published'""")
add("wallet", lambda w: accounts.wallet(w.ledger, 5).select("user_id", "id", "delta", "rank", "balance"),
    """SELECT user_id, id, delta, CAST(row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS INTEGER) AS rank,
         CAST(sum(delta) OVER (PARTITION BY user_id) AS BIGINT) AS balance FROM ledger QUALIFY rank <= 5""")
add("inbox", lambda w: accounts.inbox(w.notifications, 2).select("user_id", "id", "rank", "total", "unread"),
    """SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY user_id) AS total,
         count(*) FILTER (WHERE read_at IS NULL) OVER (PARTITION BY user_id) AS unread
       FROM notifications QUALIFY rank > 20 AND rank <= 40""")
add("links_with_challenge",
    lambda w: accounts.links_with_challenge(w.rival_links, w.challenges, NOW_VALUE).select(
        "id", "user_id", "status", F.array_join("steps", ",").alias("steps"),
        F.coalesce("expired", F.lit(False)).alias("expired")),
    """SELECT u * 3 + i AS id, u || '-' || i AS user_id, CASE WHEN i = 2 THEN 'verified' ELSE 'pending' END AS status,
         CASE i WHEN 0 THEN 'E' || (u % 5) || ',E' || ((u + 1) % 5) || ',E' || ((u + 2) % 5)
                WHEN 1 THEN 'E' || ((u + 1) % 5) || ',E' || (u % 5) END AS steps, i < 2 AS expired
       FROM (SELECT DISTINCT user_id AS u FROM e) CROSS JOIN (VALUES (0), (1), (2)) z(i) WHERE i < 2 OR u % 7 = 0""")

# --- plans ----------------------------------------------------------------------------------

add("plan_bans",
    lambda w: PB.plan_bans(w.projections.lives, w.projections.players, w.bans, w.dataset.label_kills, 24, seconds=QUALIFY)
    .drop("reason", "status"),
    f"""SELECT n.server_id, n.gamertag, n.dayz_id, n.started_at AS life_started_at,
          CASE WHEN death_cause = 'pvp' THEN 'pvp-death' WHEN k.n > 0 THEN 'kill' ELSE 'playtime' END AS qualified_by,
          n.ended_at AS banned_at, n.ended_at + INTERVAL 24 HOUR AS expires_at
        FROM named n LEFT JOIN (SELECT life_id, count(*) AS n FROM label_kills GROUP BY life_id) k ON k.life_id = n.id
        WHERE n.ended_at IS NOT NULL AND n.id % 2 <> 0
          AND (death_cause = 'pvp' OR k.n > 0 OR n.playtime_seconds >= {QUALIFY})""")
add("ban_transitions", lambda w: PB.ban_transitions(w.bans, since()).select("ban_id", "status", "new_status", "lifted_at"),
    f"""SELECT id AS ban_id, status, ns AS new_status, CASE WHEN ns IN ('expired', 'lifted') THEN {SINCE} END AS lifted_at
        FROM (SELECT *, CASE WHEN status = 'pending' THEN 'applied' WHEN status = 'applied' AND expires_at <= {SINCE}
                THEN 'expired' WHEN status = 'lift_pending' THEN 'lifted' END AS ns FROM bans) WHERE ns IS NOT NULL""")
add("plan_grants", lambda w: PL.plan_grants(w.claims, w.referrals, w.ledger, "2024-01"),
    """SELECT * FROM (
         SELECT user_id, 1 AS delta, 'verification' AS kind, 'verify:' || id AS idempotency_key FROM claims WHERE status = 'verified'
         UNION ALL SELECT user_id, 1, 'monthly', 'monthly:' || user_id || ':2024-01' FROM claims WHERE status = 'verified'
         UNION ALL SELECT r.referrer_user_id, 1, 'referral', 'referral:' || r.referrer_user_id || ':' || r.user_id
           FROM referrals r JOIN claims c USING (user_id) WHERE c.status = 'verified')
       WHERE idempotency_key NOT IN (SELECT idempotency_key FROM ledger)""")
add("expand_purchases",
    lambda w: PL.expand_purchases(w.raw("orders").select(
        F.col("o_orderkey").alias("session_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("user_id"),
        (F.col("o_orderkey") % 113).cast("int").alias("quantity")), w.ledger)[0],
    """SELECT 'C' || o_custkey AS user_id, 1 AS delta, 'purchase' AS kind, 'stripe:' || o_orderkey || ':' || n AS idempotency_key
       FROM (SELECT o_custkey, o_orderkey, unnest(range(1, o_orderkey % 113 + 1)) AS n FROM orders WHERE o_orderkey % 113 BETWEEN 1 AND 100)""",
    base=False)
add("refused_purchases",
    lambda w: PL.expand_purchases(w.raw("orders").select(
        F.col("o_orderkey").alias("session_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("user_id"),
        (F.col("o_orderkey") % 113).cast("int").alias("quantity")), w.ledger)[1],
    """SELECT o_orderkey AS session_id, 'C' || o_custkey AS user_id, CAST(o_orderkey % 113 AS INTEGER) AS quantity
       FROM orders WHERE o_orderkey % 113 NOT BETWEEN 1 AND 100""",
    base=False)
add("apply_outcomes",
    lambda w: PA.apply_outcomes(
        w.syndications, w.articles.where(F.col("id") % 5 == 0).select(
            "slug", F.lit("chat").alias("channel"), (F.col("id") % 2 == 0).alias("ok"), F.col("created_at").alias("at"),
            F.lit("timeout").alias("error")), ["slug", "channel"]),
    """SELECT coalesce(s.slug, o.slug) AS slug, coalesce(s.channel, o.channel) AS channel,
         CAST(coalesce(s.attempts, 0) + CASE WHEN o.slug IS NULL THEN 0 ELSE 1 END AS INTEGER) AS attempts,
         CASE WHEN o.ok THEN o.tm ELSE s.posted_at END AS posted_at,
         CASE WHEN NOT o.ok THEN 'timeout' END AS last_error, o.slug IS NOT NULL AS changed
       FROM syndications s FULL JOIN (SELECT slug, 'chat' AS channel, id % 2 = 0 AS ok, created_at AS tm FROM articles WHERE id % 5 = 0) o
         ON o.slug = s.slug AND o.channel = s.channel""")
add("push_failures",
    lambda w: PA.record_push_failures(w.subscriptions, w.source.where(F.col("k") < 5).select(F.col("user_id").alias("id")), now())
    .select("id", "failure_count", "disabled_at"),
    f"""SELECT s.id, CAST(s.failure_count + f.n AS INTEGER) AS failure_count,
          CASE WHEN s.failure_count + f.n >= 5 THEN {NOW} ELSE s.disabled_at END AS disabled_at
        FROM subscriptions s JOIN (SELECT user_id AS id, count(*) AS n FROM e WHERE k < 5 GROUP BY user_id) f USING (id)""")
add("verification_rivals",
    lambda w: PK.verification_effects(
        w.rival_links.where(F.col("id") % 3 == 0).select(F.col("id").alias("link_id")), w.rival_links, w.shares)[0],
    "SELECT u * 3 + 1 AS id, u || '-1' AS user_id, 'P' || u AS gamertag FROM (SELECT DISTINCT user_id AS u FROM e)")
add("verification_ended_shares",
    lambda w: PK.verification_effects(w.links.where(F.col("id") % 2 == 0).select(F.col("id").alias("link_id")), w.links, w.shares)[1]
    .select("granter_user_id", "grantee_user_id", "server_id"),
    """SELECT granter_user_id, grantee_user_id, server_id FROM shares
       WHERE granter_user_id IN (SELECT user_id FROM links WHERE id % 2 = 0)""")
DRAFT = ["user_id", "kind", "natural_key", "title", "body", "href"]
OWNED = "FROM bans b JOIN links l ON lower(l.gamertag) = lower(b.gamertag) AND l.status = 'verified' JOIN servers s ON s.id = b.server_id WHERE NOT b.dry_run"
add("draft_ban_applied", lambda w: PN.draft_ban_applied(w.dataset, since()),
    f"""SELECT l.user_id, 'ban_applied' AS kind, 'ban_applied:' || b.id AS natural_key, 'You died on a qualified life' AS title,
          s.name || ': banned for 24 hours. Spend an unban token to come back early.' AS body,
          '/players/' || lower(l.gamertag) AS href {OWNED} AND b.created_at >= {SINCE}""")
add("draft_ban_lifted", lambda w: PN.draft_ban_lifted(w.dataset, since()),
    f"""SELECT l.user_id, 'ban_lifted' AS kind, 'ban_lifted:' || b.id AS natural_key, 'You''re back in' AS title,
          s.name || CASE WHEN b.status = 'lifted' THEN ': your token was spent and the ban is lifted.'
            ELSE ': your ban has expired. Go start a new life.' END AS body, '/players/' || lower(l.gamertag) AS href
        {OWNED} AND b.status IN ('expired', 'lifted') AND b.lifted_at >= {SINCE}""")
OPEN_Q = f"""oq AS (
  SELECT n.id, n.life_number, n.started_at, l.user_id, l.gamertag AS tag, s.slug, s.name,
    least((SELECT min(k.occurred_at) FROM kills k WHERE k.server_id = n.server_id
             AND lower(k.killer_gamertag) = lower(n.gamertag) AND k.occurred_at >= n.started_at),
          (SELECT min(connected_at + to_seconds(CAST({QUALIFY} - before AS BIGINT))) FROM sess_clock c
             WHERE c.life_id = n.id AND before < {QUALIFY} AND before + share >= {QUALIFY})) AS qualified_at
  FROM named n JOIN servers s ON s.id = n.server_id
  JOIN links l ON lower(l.gamertag) = lower(n.gamertag) AND l.status = 'verified'
  WHERE n.ended_at IS NULL)"""
HREF = "'/players/' || lower(tag) || '/' || slug || '/lives/' || life_number AS href"
add("draft_life_qualified", lambda w: PN.draft_life_qualified(w.dataset, since()),
    f"""SELECT user_id, 'life_qualified' AS kind, 'life_qualified:' || id AS natural_key, 'This life counts now' AS title,
          name || ': life ' || life_number || ' is qualified. Dying costs you 24 hours.' AS body, {HREF}
        FROM oq WHERE qualified_at >= {SINCE}""", extra=OPEN_Q)
add("draft_milestones", lambda w: PN.draft_milestones(w.dataset, since()),
    f"""SELECT user_id, 'survival_milestone' AS kind, 'milestone:' || d || 'd:' || id AS natural_key, d || ' days alive' AS title,
          name || ': life ' || life_number || ' has survived ' || d || ' days.' AS body, {HREF}
        FROM oq CROSS JOIN (VALUES (7), (14), (30)) m(d)
        WHERE qualified_at IS NOT NULL AND started_at + to_days(d) <= {NOW} AND started_at + to_days(d) >= {SINCE}""",
    extra=OPEN_Q)
add("draft_account",
    lambda w: PN.draft_account(w.links, w.ledger, F.lit("2024-01-01 12:00:00").cast("timestamp") - F.expr("interval 27 years")),
    """SELECT user_id, 'gamertag_verified' AS kind, 'gamertag_verified:' || id AS natural_key, 'Gamertag verified' AS title,
         gamertag || ' is yours. Your lives are now tracked.' AS body, '/players/' || lower(gamertag) AS href
       FROM links WHERE status = 'verified'
       UNION ALL SELECT user_id, 'tokens_granted', 'tokens:' || id, 'Token granted', CASE kind
         WHEN 'monthly' THEN 'Your monthly unban token landed.' ELSE 'Verification bonus — one unban token.' END, '/'
       FROM ledger WHERE kind IN ('monthly', 'verification') AND created_at >= TIMESTAMP '1997-01-01 12:00:00'""")
add("draft_location_shared", lambda w: PN.draft_location_shared(w.dataset),
    """SELECT h.grantee_user_id AS user_id, 'location_shared' AS kind,
         'location_shared:' || h.grantee_user_id || ':' || l.gamertag || ':'
           || strftime(h.granter_session_connected_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS natural_key,
         l.gamertag || ' shared their position' AS title,
         'You can see them on ' || s.name || ' until they log out.' AS body, '/maps/' || s.slug AS href
       FROM shares h JOIN links l ON l.user_id = h.granter_user_id AND l.status = 'verified'
       JOIN servers s ON s.id = h.server_id""")
add("plan_push", lambda w: PN.plan_push(w.notifications, w.subscriptions, now(), 60 * 24 * 20).select(
        "id", "user_id", "action", "subscription_id"),
    f"""SELECT n.id, n.user_id, CASE WHEN n.created_at < {NOW} - INTERVAL 20 DAY THEN 'skip_old' WHEN s.id IS NULL THEN 'skip_none'
          ELSE 'send' END AS action, CASE WHEN n.created_at >= {NOW} - INTERVAL 20 DAY THEN s.id END AS subscription_id
        FROM notifications n LEFT JOIN subscriptions s ON s.user_id = n.user_id AND s.disabled_at IS NULL
        WHERE n.pushed_at IS NULL""")

# --- sequences and text ---------------------------------------------------------------------

STEP = """s{n} AS (SELECT c.*, (SELECT min(m.event_id) FROM em m WHERE m.label = c.label AND m.token = c.seq[{n}]
    AND m.event_id > coalesce(c.e{p}, -1)) AS e{n} FROM s{p} c)"""
add("verify_challenges",
    lambda w: K.verify_challenges(w.emotes, w.challenges, w.rival_links).select(
        "challenge_id", "progress_index", "last_matched_event_id", "completed_at", "status"),
    """SELECT challenge_id, CAST(len(m) AS INTEGER) AS progress_index, coalesce(list_max(m), 0) AS last_matched_event_id,
         CASE WHEN len(m) = len(seq) THEN (SELECT tm FROM em x WHERE x.event_id = list_max(m)) END AS completed_at,
         CASE WHEN winner = challenge_id THEN 'verified' WHEN winner IS NOT NULL THEN 'cancelled'
              WHEN owned AND len(m) = len(seq) THEN 'cancelled' ELSE 'pending' END AS status
       FROM (SELECT f.*, w.winner, list_filter([e1, e2, e3], lambda x: x IS NOT NULL AND (w.won IS NULL OR x <= w.won)) AS m
             FROM fin f LEFT JOIN win w USING (label))""",
    extra="""em AS (SELECT event_id, 'p' || user_id AS label, 'E' || (k % 5) AS token, tm FROM e WHERE event_type = 'click'
        AND tm > TIMESTAMP '2024-01-05' AND tm < TIMESTAMP '2024-01-25'),
      s0 AS (SELECT u * 3 + i AS challenge_id, 'p' || u AS label, u % 7 = 0 AS owned, CAST(NULL AS BIGINT) AS e0,
        CASE i WHEN 0 THEN ['E' || (u % 5), 'E' || ((u + 1) % 5), 'E' || ((u + 2) % 5)]
               ELSE ['E' || ((u + 1) % 5), 'E' || (u % 5)] END AS seq
        FROM (SELECT DISTINCT user_id AS u FROM e) CROSS JOIN (VALUES (0), (1)) z(i)),"""
    + ",".join([STEP.format(n=1, p=0),
                STEP.format(n=2, p=1).replace("FROM em m WHERE", "FROM em m WHERE c.e1 IS NOT NULL AND"),
                STEP.format(n=3, p=2).replace("FROM em m WHERE", "FROM em m WHERE c.e2 IS NOT NULL AND")])
    + """, fin AS (SELECT *, CASE WHEN len(seq) = 3 THEN e3 ELSE e2 END AS done FROM s3),
      win AS (SELECT label, arg_min(challenge_id, struct_pack(a := done, b := challenge_id)) AS winner, min(done) AS won
        FROM fin WHERE done IS NOT NULL AND NOT owned GROUP BY label)""")
TERMS = ["the", "of", "and", "une", "der", "worthless", "of the", "is"]
add("scan_terms",
    lambda w: TX.scan_terms(w.raw("documents").withColumn("ex", F.array(F.lit("And"), F.lit(""))), TERMS, exempt="ex"),
    """SELECT doc_id, term FROM (SELECT doc_id, unnest(['the', 'of', 'une', 'der', 'worthless', 'is']) AS term,
           string_split_regex(replace(lower(text), 'and', ' '), '[^a-z0-9]+') AS toks FROM documents) WHERE list_contains(toks, term)
       UNION ALL SELECT doc_id, 'of the' FROM documents
         WHERE regexp_matches(replace(lower(text), 'and', ' '), '(^|[^a-z0-9])of the($|[^a-z0-9])')
       UNION ALL SELECT doc_id, 'and' FROM documents
         WHERE list_contains(string_split_regex(replace(lower(text), 'and', ' '), '[^a-z0-9]+'), 'and')""", base=False)
add("find_mentions",
    lambda w: TX.find_mentions(w.raw("documents").withColumn(
        "roster", F.array(F.lit("The"), F.lit("Of the"), F.concat(F.lit("s"), F.substring("lang", 1, 1))))),
    """SELECT doc_id, CAST(at_end - length(m) AS INTEGER) AS start, m AS name FROM (
         SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS at_end,
           right(coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY i), '') || gap, 1) AS l,
           left(nxt || coalesce(lead(m) OVER (PARTITION BY doc_id ORDER BY i), ''), 1) AS r
         FROM (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(gaps[2:len(ms) + 1]) AS nxt,
                 unnest(range(len(ms))) AS i
               FROM (SELECT doc_id, regexp_extract_all(text, '(?i)of the|the|s' || lang[1]) AS ms,
                       string_split_regex(text, '(?i)of the|the|s' || lang[1]) AS gaps FROM documents)))
       WHERE NOT regexp_matches(l, '[A-Za-z0-9_]') AND NOT regexp_matches(r, '[A-Za-z0-9_]')""", base=False)
add("dedupe_quotes",
    lambda w: TX.dedupe_quotes(
        w.prose.where(F.col("status") != "published").select(
            "id", F.col("lang").alias("quote_text"), F.upper("kind").alias("quote_attribution")),
        w.prose.where((F.col("status") == "published") & (F.col("lang") == "fr")).select(F.col("kind").alias("attribution"))),
    """SELECT id, CASE WHEN NOT used THEN lang END AS quote_text, CASE WHEN NOT used THEN upper(kind) END AS quote_attribution
       FROM (SELECT *, kind IN (SELECT kind FROM prose WHERE status = 'published' AND lang = 'fr') AS used
             FROM prose WHERE status <> 'published')""")

# --- log text -------------------------------------------------------------------------------

LINES = """ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY server_id ORDER BY event_id) AS INTEGER) AS line_index,
    'server-' || server_id AS file FROM ev),
  px AS (SELECT *, CAST(printf('%.2f', value * 30) AS DOUBLE) AS x, CAST(k * 150 AS DOUBLE) AS y,
      value * 30 <= 16360 AND k * 150 <= 16360 AS inside FROM ln),
  clk0 AS (SELECT server_id, line_index, event_id, t, tm, CAST(epoch(date_trunc('second', tm)) AS BIGINT) % 86400 AS sec,
      lag(CAST(epoch(date_trunc('second', tm)) AS BIGINT) % 86400, 1, 0) OVER (PARTITION BY server_id ORDER BY line_index) AS before
    FROM ln),
  clk1 AS (SELECT *, CASE WHEN t <> 'boot' AND before - sec > 43200 THEN 1 ELSE 0 END AS roll,
      count(*) FILTER (WHERE t = 'boot') OVER (PARTITION BY server_id ORDER BY line_index) AS seg FROM clk0),
  clk AS (SELECT *, coalesce(max(CASE WHEN t = 'boot' THEN date_trunc('day', tm) END) OVER (PARTITION BY server_id, seg),
      TIMESTAMP '2024-01-01') + to_days(CAST(sum(roll) OVER (PARTITION BY server_id, seg ORDER BY line_index) AS INTEGER))
      + to_seconds(sec) AS stamp FROM clk1)"""
add("parse_lines",
    lambda w: EX.parse_lines(w.log_lines.where(F.col("event_id").isNotNull()).select("file", "line_index", "text"))
    .select("file", "line_index", "sub_index", "type"),
    """SELECT file, line_index, CAST(row_number() OVER (PARTITION BY file, line_index ORDER BY o) - 1 AS INTEGER) AS sub_index, type
       FROM (
         SELECT file, line_index, 0 AS o, CASE t WHEN 'boot' THEN 'server.rebooted' WHEN 'connect' THEN 'player.connected'
           WHEN 'leave' THEN 'player.disconnected' WHEN 'die' THEN 'player.died' WHEN 'hit' THEN 'player.hit'
           ELSE 'build.placed' END AS type FROM px WHERE t NOT IN ('fix', 'down')
         UNION ALL SELECT file, line_index, 1, 'player.position' FROM px WHERE t NOT IN ('boot', 'hit') AND inside
         UNION ALL SELECT file, line_index, 2, 'player.unconscious' FROM px WHERE t = 'down')""", extra=LINES)
add("extracted_fields",
    lambda w: typed_events(EX.parse_lines(w.log_lines.where(F.col("event_id").isNotNull()).select("event_id", "text")))
    .where(F.col("type").isin("player.died", "player.hit", "player.position", "build.placed")).select(
        "event_id", "type", F.coalesce("victim", "gamertag").alias("who"), "cause", "killer", "weapon", "distance", "energy",
        "death_entity", "victim_hp", "attacker_type", "attacker_gamertag", "attacker_label", "body_part", "x", "y", "object"),
    """SELECT event_id, type, label AS who,
         CASE WHEN type <> 'player.died' THEN NULL WHEN k % 2 = 0 THEN 'pvp' WHEN k % 10 = 1 THEN 'suicide' WHEN k % 10 = 3 THEN 'bled_out'
           WHEN k % 10 = 5 THEN 'wolf' WHEN k % 10 = 7 THEN 'died' ELSE 'environment' END AS cause,
         CASE WHEN type = 'player.died' AND k % 2 = 0 THEN 'P' || (user_id + 1 + k % 5) END AS killer,
         CASE WHEN type = 'player.died' AND k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'M4A1' WHEN 1 THEN 'Hunting Knife' ELSE 'SKS' END END AS weapon,
         CASE WHEN type = 'player.died' AND k % 2 = 0 THEN CAST(printf('%.2f', value) AS DOUBLE) END AS distance,
         CASE WHEN type = 'player.died' AND k % 10 = 7 THEN CAST(k % 4 AS DOUBLE) END AS energy,
         CASE WHEN type = 'player.died' AND k % 10 = 5 THEN 'Animal_CanisLupus_Grey'
              WHEN type = 'player.died' AND k % 10 = 9 THEN 'BarbedWire' END AS death_entity,
         CASE WHEN type = 'player.hit' THEN CAST(printf('%.2f', value) AS DOUBLE) END AS victim_hp,
         CASE WHEN type = 'player.hit' THEN CASE k % 3 WHEN 0 THEN 'player' WHEN 1 THEN 'infected' ELSE 'environment' END END AS attacker_type,
         CASE WHEN type = 'player.hit' AND k % 3 = 0 THEN 'P' || (user_id + 1 + k % 5) END AS attacker_gamertag,
         CASE WHEN type = 'player.hit' AND k % 3 = 1 THEN 'Infected' WHEN type = 'player.hit' AND k % 3 = 2 THEN
           CASE k % 5 WHEN 0 THEN 'FireplaceBase' WHEN 2 THEN 'FallDamageHealth' ELSE 'BarbedWire' END END AS attacker_label,
         CASE WHEN type = 'player.hit' AND k % 4 <> 0 THEN 'Torso' END AS body_part,
         CASE WHEN type <> 'player.died' AND inside THEN x END AS x, CASE WHEN type <> 'player.died' AND inside THEN y END AS y,
         CASE WHEN type = 'build.placed' THEN 'Fence' || (k % 7) END AS object
       FROM (SELECT *, CASE t WHEN 'die' THEN 'player.died' WHEN 'hit' THEN 'player.hit' ELSE 'build.placed' END AS type FROM px
               WHERE t IN ('die', 'hit', 'build')
             UNION ALL SELECT *, 'player.position' FROM px WHERE t NOT IN ('boot', 'hit') AND inside)""", extra=LINES)
add("line_timestamps", lambda w: w.stamped_lines.where(F.col("event_id").isNotNull()).select("event_id", "occurred_at"),
    "SELECT event_id, CASE WHEN t <> 'boot' THEN stamp END AS occurred_at FROM clk", extra=LINES)
add("backfill_unconscious",
    lambda w: BF.backfill_unconscious(
        w.raw_lines, w.raw_lines.where(F.col("raw_line_id") % 2 == 0).select(
            "server_id", "file_id", "line_index", F.lit(1).alias("sub_index")))
    .select("raw_line_id", "line_index", "occurred_at"),
    """SELECT event_id AS raw_line_id, line_index, stamp AS occurred_at FROM clk WHERE t = 'down' AND event_id % 2 = 1""",
    extra=LINES)
add("rederive_causes",
    lambda w: BF.rederive_causes(w.vague_deaths, w.raw_lines)[0].select(
        "event_id", F.get_json_object("payload", "$.cause").alias("cause"),
        F.get_json_object("payload", "$.deathEntity").alias("entity")),
    """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'pvp' WHEN k % 10 = 1 THEN 'suicide' WHEN k % 10 = 3 THEN 'bled_out'
         WHEN k % 10 = 5 THEN 'wolf' ELSE 'died' END AS cause,
         CASE k % 10 WHEN 5 THEN 'Animal_CanisLupus_Grey' WHEN 9 THEN 'BarbedWire' END AS entity
       FROM ev WHERE t = 'die' AND k % 10 <> 7""")
add("unmapped_entities", lambda w: BF.rederive_causes(w.vague_deaths, w.raw_lines)[1],
    "SELECT 'BarbedWire' AS entity, count(*) AS deaths FROM ev WHERE t = 'die' AND k % 10 = 9 HAVING count(*) > 0")
add("rederive_vitals",
    lambda w: BF.rederive_vitals(w.vague_deaths, w.raw_lines).select(
        "event_id", F.get_json_object("payload", "$.energy").cast("double").alias("energy"),
        F.get_json_object("payload", "$.bleedSources").cast("int").alias("bleed")),
    """SELECT event_id, CAST(k % 4 AS DOUBLE) AS energy, k % 3 AS bleed FROM ev WHERE t = 'die' AND k % 10 = 7""")
FILES = """df AS (SELECT server_id, date_trunc('day', tm) AS started_at, max(tm) + INTERVAL 5 HOUR AS modified_at,
    'f-' || server_id || '-' || strftime(date_trunc('day', tm), '%Y%m%d') AS file, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY ALL)"""
add("clock_offsets", lambda w: L.clock_offsets(w.day_files, w.servers),
    """SELECT server_id, CAST(floor(min((epoch_us(modified_at) // 1000) - (epoch_us(started_at) // 1000)) / 900000.0 + 0.5) * 900000 AS BIGINT)
         AS clock_offset_ms FROM df GROUP BY server_id""", extra=FILES)
add("files_to_load", lambda w: L.files_to_load(w.day_files, w.day_cursor, 5),
    """SELECT server_id, file, started_at, newest AS is_newest,
         CASE WHEN started_at < TIMESTAMP '2024-01-11' THEN n ELSE 0 END AS last_processed_line FROM (
         SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY newest, started_at) AS place,
           count(*) FILTER (WHERE NOT newest) OVER (PARTITION BY server_id) AS closed FROM (
           SELECT *, started_at = max(started_at) OVER (PARTITION BY server_id) AS newest FROM df)
         WHERE newest OR started_at >= TIMESTAMP '2024-01-11')
       WHERE CASE WHEN newest THEN closed <= 5 ELSE place <= 5 END""", extra=FILES)
add("incremental_lines",
    lambda w: L.incremental_lines(
        w.log_lines.where(F.col("event_id").isNotNull()).select("event_id", "file", "line_index"),
        w.servers.select(F.concat(F.lit("server-"), F.col("id").cast("string")).alias("file"),
                         (F.col("id") * 100).alias("last_processed_line")).where(F.col("file") != "server-3")),
    """SELECT event_id, file, line_index FROM ln WHERE line_index >= CASE WHEN server_id < 3 THEN server_id * 100 ELSE 0 END""",
    extra=LINES)

def _reply(body: str, tags: int = 2) -> Column:
    """A reply in JSON with a text as its body."""
    none = F.lit(None).cast("struct<text:string,attribution:string>")
    return F.to_json(F.struct(F.lit("Head").alias("headline"), F.lit("Lede").alias("lede"), F.col(body).alias("body"),
                              none.alias("pullQuote"), F.array(*[F.lit(f"t{i}") for i in range(tags)]).alias("tags")),
                     {"ignoreNullFields": "false"})

# --- kinds of lines, files and functions that the tables above do not reach ---------------------

add("varied_lines",
    lambda w: EX.parse_lines(w.varied_lines).select(
        "event_id", "sub_index", "type", *[F.get_json_object("payload", f"$.{f}").alias(f) for f in (
            "count", "gamertag", "victim", "dayzId", "cause", "deathEntity", "bodyPart", "action", "object", "className", "tool",
            "emote", "item", "reason", "disconnecting")],
        F.get_json_object("payload", "$.damage").cast("double").alias("damage"),
        F.get_json_object("payload", "$.to[1]").cast("double").alias("to_y"),
        F.get_json_object("payload", "$.x").cast("double").alias("x"), F.get_json_object("payload", "$.y").cast("double").alias("y")),
    """SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS INTEGER) AS sub_index, type,
         CASE WHEN type = 'roster.snapshot' THEN k::VARCHAR END AS "count",
         CASE WHEN type NOT IN ('roster.snapshot', 'player.died', 'player.hit') THEN label END AS gamertag,
         CASE WHEN type IN ('player.died', 'player.hit') THEN label END AS victim,
         CASE WHEN type IN ('player.connecting', 'player.died', 'player.disconnected') THEN 'H' || user_id END AS dayzId,
         CASE WHEN type = 'player.died' THEN CASE m WHEN 2 THEN 'drowned' WHEN 3 THEN 'infected' WHEN 4 THEN 'fall' WHEN 5 THEN 'vehicle'
           WHEN 6 THEN 'bear' END END AS cause,
         CASE WHEN type = 'player.died' THEN CASE m WHEN 3 THEN 'ZmbM_CitizenASkinny' WHEN 4 THEN 'FallDamage' WHEN 5 THEN 'CivilianSedan'
           WHEN 6 THEN 'Animal_UrsusArctos' END END AS deathEntity,
         CASE WHEN type = 'player.hit' THEN 'Head' END AS bodyPart,
         CASE WHEN type = 'build.dismantled' THEN 'dismantled' END AS action, CASE WHEN type = 'build.dismantled' THEN 'Wall' || k END AS object,
         CASE WHEN type = 'build.dismantled' THEN 'Fence' END AS className, CASE WHEN type = 'build.dismantled' THEN 'Pliers' END AS tool,
         CASE WHEN type = 'emote.performed' THEN 'EmoteSalute' END AS emote, CASE WHEN type = 'emote.performed' THEN 'Rag' END AS item,
         CASE WHEN type = 'player.teleported' THEN 'admin call' END AS reason,
         CASE WHEN type = 'player.unconscious' THEN 'true' END AS disconnecting,
         CASE WHEN type = 'player.hit' THEN k * 0.5::DOUBLE END AS damage,
         CASE WHEN type = 'player.teleported' THEN k + 0.5::DOUBLE END AS to_y,
         CASE WHEN type IN ('player.hit', 'build.dismantled', 'emote.performed', 'player.position', 'player.unconscious')
              THEN printf('%.2f', value)::DOUBLE END AS x,
         CASE WHEN type IN ('player.hit', 'build.dismantled', 'emote.performed', 'player.position', 'player.unconscious')
              THEN k::DOUBLE END AS y
       FROM (SELECT *, 'P' || user_id AS label FROM (
         SELECT *, 0 AS o, CASE m WHEN 0 THEN 'roster.snapshot' WHEN 1 THEN 'player.connecting' WHEN 7 THEN 'player.hit'
           WHEN 8 THEN 'build.dismantled' WHEN 9 THEN 'emote.performed' WHEN 10 THEN 'player.teleported' WHEN 15 THEN 'player.disconnected'
           ELSE 'player.died' END AS type FROM vm WHERE m NOT IN (11, 12, 13, 14)
         UNION ALL SELECT *, 1, 'player.position' FROM vm WHERE m NOT IN (0, 1, 7, 11, 13)
         UNION ALL SELECT *, 2, 'player.unconscious' FROM vm WHERE m = 12))""",
    extra="vm AS (SELECT *, event_id % 16 AS m FROM ev)")
add("events_from_lines",
    lambda w: EX.events_from_lines(w.log_lines.where(F.col("event_id").isNotNull()))
    .groupBy("event_id", "occurred_at").agg(F.count("*").alias("events"), F.max("sub_index").alias("last_index")),
    """SELECT p.event_id, CASE WHEN p.t = 'boot' THEN TIMESTAMP '2024-01-01' ELSE c.stamp END AS occurred_at,
         CAST(n AS BIGINT) AS events, CAST(n - 1 AS INTEGER) AS last_index
       FROM (SELECT *, CASE WHEN t NOT IN ('fix', 'down') THEN 1 ELSE 0 END + CASE WHEN t NOT IN ('boot', 'hit') AND inside THEN 1 ELSE 0 END
               + CASE WHEN t = 'down' THEN 1 ELSE 0 END AS n FROM px) p JOIN clk c USING (event_id) WHERE n > 0""",
    extra=LINES)
add("log_files",
    lambda w: L.log_files(w.spark, w.log_folder).select("server_id", "name", "started_at"),
    """SELECT DISTINCT CAST(server_id AS INTEGER) AS server_id, 'DayZServer_X1_x64_2024-01-0' || server_id || '_00-00-00.ADM' AS name,
         TIMESTAMP '2024-01-01' + to_days(CAST(server_id - 1 AS INTEGER)) AS started_at FROM ev""")
add("read_log_lines",
    lambda w: L.read_log_lines(w.spark, w.log_folder).select("server_id", "line_index", F.regexp_extract("text", r"^\S+", 0).alias("head"),
                                                             "started_at"),
    """SELECT CAST(server_id AS INTEGER) AS server_id, line_index, CASE WHEN t = 'boot' THEN 'AdminLog' ELSE strftime(tm, '%H:%M:%S') END AS head,
         TIMESTAMP '2024-01-01' + to_days(CAST(server_id - 1 AS INTEGER)) AS started_at FROM ln
       UNION ALL SELECT DISTINCT CAST(server_id AS INTEGER), 0, 'AdminLog',
         TIMESTAMP '2024-01-01' + to_days(CAST(server_id - 1 AS INTEGER)) FROM ln""", extra=LINES)


def _swept(w):
    lines, broken = L.sweep_logs(w.spark, w.damaged_folder)
    kept = lines.groupBy("server_id").agg(F.count("*").alias("n"))
    return kept.join(broken.groupBy("server_id").agg(F.max("reason").alias("reason")), "server_id", "left")


add("swept_lines", _swept,
    """SELECT CAST(server_id AS INTEGER) AS server_id, count(*) + 1 AS n, CASE WHEN server_id = 2 THEN 'undecodable' END AS reason
       FROM ln GROUP BY server_id""", extra=LINES)


def _saved(w):
    path = f"{stage_root(w.spark)}/lifelog-saved-{uuid.uuid4().hex}"
    S.save_tables({"links": w.links, "servers": w.servers}, path)
    tables = S.load_tables(w.spark, path, ["links", "servers"])
    return tables["links"].select("user_id", "gamertag", "status").unionByName(
        tables["servers"].select(F.col("slug").alias("user_id"), F.col("name").alias("gamertag"), F.col("map").alias("status")))


add("saved_tables", _saved,
    "SELECT user_id, gamertag, status FROM links UNION ALL SELECT slug, name, map FROM servers")
add("backfill_account_ids",
    lambda w: S.backfill_account_ids(w.bans.withColumn("dayz_id", F.when(F.col("id") % 2 == 0, F.lit("old"))), w.projections.players)
    .select("id", "dayz_id"),
    """SELECT b.id, coalesce((SELECT any_value(p.dayz_id) FROM players p WHERE lower(p.gamertag) = lower(b.gamertag)),
         CASE WHEN b.id % 2 = 0 THEN 'old' END) AS dayz_id FROM bans b""")
add("quarantined_events",
    lambda w: validate_events(w.events.withColumn("payload", F.when(F.col("event_id") % 7 == 0, F.expr("substr(payload, 1, length(payload) - 1)"))
                                                  .when(F.col("event_id") % 7 == 1, F.lit("{}"))
                                                  .when(F.col("event_id") % 7 == 2, F.lit(None).cast("string")).otherwise(F.col("payload"))))[1]
    .select("event_id", "type"),
    """SELECT event_id, CASE t WHEN 'connect' THEN 'player.connected' WHEN 'leave' THEN 'player.disconnected'
         WHEN 'die' THEN 'player.died' WHEN 'down' THEN 'player.unconscious' WHEN 'build' THEN 'build.placed'
         WHEN 'boot' THEN 'server.rebooted' WHEN 'fix' THEN 'player.position' ELSE 'player.hit' END AS type
       FROM ev WHERE event_id % 7 IN (0, 2) OR event_id % 7 = 1 AND t <> 'down'  -- no field is asked of a knockout""")
_EMOTE_ROWS = ", ".join(f"('{label}', '{token}', {str(safe).lower()})" for label, token, safe in EMOTES)


def _emote_labels() -> Column:
    return F.array(*[F.lit(label) for label, _, _ in EMOTES], F.lit("wave"))


add("emote_tokens",
    lambda w: w.source.select("event_id", F.upper(F.element_at(_emote_labels(), (F.col("event_id") % (len(EMOTES) + 1) + 1).cast("int"))).alias("label"))
    .withColumn("token", X.emote_token(F.col("label"))).select(
        "event_id", "token", X.emote_label(F.col("token")).alias("name"), X.emote_is_safe(F.col("token")).alias("safe")),
    f"""SELECT e.event_id, m.token, m.name, coalesce(m.safe, false) AS safe FROM ev e
        LEFT JOIN (SELECT *, row_number() OVER () - 1 AS n FROM (VALUES {_EMOTE_ROWS}) v(name, token, safe)) m
          ON e.event_id % {len(EMOTES) + 1} = m.n""")
add("next_even_hour",
    lambda w: w.source.select("event_id", X.ms_to_next_even_hour(F.col("at")).alias("wait_ms")),
    "SELECT event_id, 7200000 - (epoch_us(tm) // 1000) % 7200000 AS wait_ms FROM ev")
add("place_labels",
    lambda w: w.source.select("event_id", F.element_at(F.array(*map(F.lit, ("capital", "city", "village", "hill", "camp"))),
                                                       (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), (F.col("k") % 6).alias("zoom"))
    .where(X.place_visible(F.col("kind"), F.col("zoom"))),
    """SELECT * FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'capital' WHEN 1 THEN 'city' WHEN 2 THEN 'village' WHEN 3 THEN 'hill' ELSE 'camp' END AS kind,
         CAST(k % 6 AS INTEGER) AS zoom FROM ev)
       WHERE zoom >= CASE kind WHEN 'capital' THEN 0 WHEN 'city' THEN 0 WHEN 'village' THEN 2 ELSE 4 END""")
add("rap_sheets",
    lambda w: w.dataset.life_status.select("id", "seconds", "kills_counted").join(w.projections.lives.select("id", "death_cause"), "id").select(
        "id", F.inline(X.rap_sheet(F.col("seconds"), F.col("kills_counted"), F.when(F.col("kills_counted") > 0, F.col("kills_counted") * 10.5),
                                   F.coalesce("death_cause", F.lit("alive"))))),
    """SELECT id, label, value, hot FROM (
         SELECT s.id, 'Kills' AS label, CAST(s.kills_counted AS VARCHAR) AS value, false AS hot FROM status s
         UNION ALL SELECT id, 'Longest kill', CAST(CAST(floor(kills_counted * 10.5 + 0.5) AS BIGINT) AS VARCHAR) || 'm', false FROM status WHERE kills_counted > 0
         UNION ALL SELECT s.id, 'Cause', coalesce(l.death_cause, 'alive'), true FROM status s JOIN lives l USING (id)
         UNION ALL SELECT id, 'Survived', CASE WHEN s < 60 THEN s || 's' ELSE trim(
             CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END ||
             CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h ' ELSE '' END ||
             CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' ELSE '' END) END, false
           FROM (SELECT id, CAST(seconds AS BIGINT) AS s FROM status))""")
add("salvaged_replies",
    lambda w: w.prose.select("id", X.salvage_reply(F.when(F.col("id") % 4 == 0, F.concat(F.lit("Sure: "), _reply("text")))
                                                   .when(F.col("id") % 4 == 1, F.lit("no object"))
                                                   .when(F.col("id") % 4 == 2, _reply("text", tags=7)).otherwise(_reply("text"))).alias("r")).select(
        "id", F.col("r").isNotNull().alias("sound"), F.length("r.body").alias("chars"), F.size(F.coalesce("r.tags", F.array().cast("array<string>"))).alias("tags")),
    """SELECT id, ok AS sound, CASE WHEN ok THEN length(text) END AS chars, CASE WHEN ok THEN 2 ELSE 0 END AS tags
       FROM (SELECT id, text, id % 4 IN (0, 3) AND length(trim(text)) > 0 AS ok FROM prose)""")

# --- shared and changed labels ---------------------------------------------------------------

RENAMED = """nv AS (SELECT *, 'N' || ((user_id * 3 + k) % 25) AS lab FROM ev),
  nc AS (SELECT c.*, f.player_id FROM nv c JOIN fc f USING (user_id) WHERE c.t = 'connect'),
  nt AS (SELECT a.player_id, a.event_id, a.lab, min(b.event_id) AS left_at FROM nc a
         LEFT JOIN nc b ON b.user_id = a.user_id AND b.event_id > a.event_id AND b.lab <> a.lab GROUP BY ALL),
  nh AS (SELECT v.event_id, arg_max(n.player_id, n.event_id) AS player_id FROM nv v
         JOIN nt n ON n.lab = v.lab AND n.event_id < v.event_id AND (n.left_at IS NULL OR n.left_at > v.event_id)
         WHERE v.t NOT IN ('connect', 'boot') GROUP BY 1),
  nr AS (SELECT v.event_id, v.t, v.tm, v.lab, coalesce(c.player_id, h.player_id) AS player_id FROM nv v
         LEFT JOIN nc c ON c.event_id = v.event_id LEFT JOIN nh h ON h.event_id = v.event_id WHERE v.t <> 'boot'),
  npl AS (SELECT player_id, arg_max(lab, event_id) FILTER (WHERE t = 'connect') AS gamertag, arg_min(tm, event_id) AS first_seen_at,
            arg_max(tm, event_id) AS last_seen_at FROM nr WHERE t IN ('connect', 'leave', 'fix') AND player_id IS NOT NULL GROUP BY 1),
  nal AS (SELECT player_id, lab AS gamertag, arg_min(tm, event_id) AS first_seen_at, max(tm) AS last_seen_at FROM nc GROUP BY 1, 2),
  cur AS (SELECT gamertag, arg_max(player_id, (last_seen_at, -player_id)) AS player_id FROM npl GROUP BY 1),
  old AS (SELECT gamertag, arg_max(player_id, (last_seen_at, -player_id)) AS player_id FROM nal GROUP BY 1),
  nn AS (SELECT coalesce(c.gamertag, o.gamertag) AS gamertag, coalesce(c.player_id, o.player_id) AS player_id, c.player_id IS NULL AS via_alias
         FROM cur c FULL JOIN old o ON c.gamertag = o.gamertag),
  nlk AS (SELECT id, user_id, 'n' || (id % 30) AS gamertag, status FROM links),
  nb AS (SELECT * REPLACE ('N' || ((id // 2) % 28) AS gamertag) FROM bans)"""
add("renamed_labels", lambda w: w.renamed.resolved.where(F.col("type") != "server.rebooted").select("event_id", "player_id"),
    "SELECT event_id, player_id FROM nr", extra=RENAMED)
add("renamed_players", lambda w: w.renamed.players.select("id", "gamertag", "first_seen_at", "last_seen_at"),
    "SELECT player_id AS id, gamertag, first_seen_at, last_seen_at FROM npl", extra=RENAMED)
add("renamed_aliases", lambda w: w.renamed.player_gamertags, "SELECT * FROM nal", extra=RENAMED)
add("renamed_slugs",
    lambda w: J.resolve_slugs(w.renamed_links.select("id", "gamertag"), "gamertag", w.renamed.players, w.renamed.player_gamertags)
    .select("id", "player_id", "via_alias"),
    """SELECT l.id, n.player_id, coalesce(n.via_alias, false) AS via_alias FROM nlk l LEFT JOIN nn n ON lower(n.gamertag) = l.gamertag""",
    extra=RENAMED)
add("renamed_links", lambda w: J.resolve_links(w.renamed_links, w.renamed.players).select("link_id", "user_id", "player_id"),
    """SELECT l.id AS link_id, l.user_id, c.player_id FROM nlk l JOIN cur c ON lower(c.gamertag) = l.gamertag WHERE l.status = 'verified'""",
    extra=RENAMED)
add("renamed_owned_bans",
    lambda w: J.owned_bans(w.renamed_links, w.renamed_bans, w.renamed.players, w.renamed.player_gamertags).select("user_id", "ban_id", "status"),
    """SELECT DISTINCT l.user_id, b.id AS ban_id, b.status FROM nb b JOIN nn p ON p.gamertag = b.gamertag
       JOIN nn q ON q.player_id = p.player_id JOIN nlk l ON l.gamertag = lower(q.gamertag) AND l.status = 'verified'
       WHERE b.status IN ('pending', 'applied') AND NOT b.dry_run""", extra=RENAMED)
add("renamed_avatars",
    lambda w: J.avatar_hash(w.renamed.players.select(F.col("id").alias("player_id"), "gamertag"), w.renamed_links, w.avatars,
                            w.renamed.player_gamertags),
    """SELECT p.player_id, p.gamertag, x.hash AS avatar_hash FROM npl p LEFT JOIN (
         SELECT player_id, arg_min(hash, (via, link_id)) AS hash FROM (
           SELECT n.player_id, n.via, l.id AS link_id, a.hash FROM (
             SELECT player_id, lower(gamertag) AS lab, 0 AS via FROM npl UNION ALL SELECT player_id, lower(gamertag), 1 FROM nal) n
           JOIN nlk l ON l.gamertag = n.lab AND l.status = 'verified' JOIN avatars a ON a.user_id = l.user_id) GROUP BY 1) x
       USING (player_id)""", extra=RENAMED)

# --- streams, run to their end over the events as files -----------------------------------------


def _event_stream(w, copies: int = 1) -> tuple[DataFrame, str]:
    """(stream of the event log, working folder); with ``copies`` every event arrives that often."""
    folder = f"{stage_root(w.spark)}/lifelog-stream-{uuid.uuid4().hex}"
    for n in range(copies):
        w.events.repartition(2, "event_id").write.mode("append").parquet(f"{folder}/in")
    return w.spark.readStream.schema(w.events.schema).parquet(f"{folder}/in"), folder


def _appended_once(w) -> DataFrame:
    events, folder = _event_stream(w, copies=2)
    sink = append_once(f"{folder}/out", ["server_id", "event_id"], ["server_id"])
    events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/cursor").trigger(
        availableNow=True).start().awaitTermination()
    return w.spark.read.parquet(f"{folder}/out")


#: Columns of the projector's tables that the queries of the rebuild of the same name return.
STREAMED = {
    "players": ("players", "id gamertag dayz_id first_seen_at last_seen_at"),
    "aliases": ("player_gamertags", "player_id gamertag first_seen_at last_seen_at"),
    "lives": ("lives", "id server_id player_id life_number started_at ended_at death_cause death_by_gamertag death_weapon"
              " death_distance energy_at_death water_at_death bleed_sources_at_death playtime_seconds end_event_id"),
    "sessions": ("sessions", "id server_id player_id life_id connected_at disconnected_at duration_seconds close_reason"),
    "kills": ("kills", "server_id killer_gamertag killer_player_id victim_gamertag victim_player_id victim_life_id weapon"
              " distance occurred_at event_id"),
    "hits": ("hit_events", "event_id server_id victim_gamertag victim_player_id attacker_gamertag attacker_type"
             " attacker_label body_part victim_hp occurred_at"),
    "builds": ("build_events", "event_id server_id gamertag player_id life_id action object occurred_at"),
    "positions": ("positions", "event_id server_id player_id gamertag x y recorded_at"),
    "knockouts": ("unconscious_events", "server_id player_id gamertag disconnecting occurred_at"),
}
# The tables of the projector after batches in and out of order are those of the rebuild, with the same SQL.
for _query, (_table, _columns) in STREAMED.items():
    def _streamed(spark, sf_dir, table=_table, columns=_columns):
        return ntz(read_projection(spark, world(spark, sf_dir).streamed, table).select(*columns.split()))

    QUERIES[f"stream_{_query}"], ORACLE[f"stream_{_query}"] = _streamed, ORACLE[_query]
add("stream_appended_once",
    lambda w: _appended_once(w).groupBy(F.col("server_id").cast("int").alias("server_id")).agg(
        F.count("*").alias("events"), F.sum("event_id").alias("ids")),
    "SELECT server_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM ev GROUP BY server_id")

# --- session windows (the batch side of the streaming operators) ------------------------------

WINDOW_SQL = """SELECT {keys}, min(tm) AS {a}, max(tm) AS {b}{more} FROM (
    SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY tm, event_id) AS n FROM (
      SELECT *, CASE WHEN epoch_us(tm) - epoch_us(lag(tm) OVER (PARTITION BY {keys} ORDER BY tm, event_id)) <= {gap} * CAST(1000000 AS BIGINT)
        THEN 0 ELSE 1 END AS opens FROM {source})) GROUP BY {keys}, n"""
add("encounter_windows", lambda w: stream_encounters(w.dataset.life_hits, ["life_id", "attacker_type"], GAP),
    WINDOW_SQL.format(keys="life_id, attacker_type", a="started_at", b="last_at", gap=GAP,
                      more=", count(*) AS hits, min(victim_hp) AS hp_low",
                      source="(SELECT *, occurred_at AS tm FROM life_hits)"))
add("presence_spans",
    lambda w: presence_spans(w.projections.resolved.where(
        F.col("type").isin("player.connected", "player.position") & F.col("player_id").isNotNull()), FRESH),
    WINDOW_SQL.format(keys="server_id, player_id", a="seen_from", b="seen_to", gap=FRESH,
                      more=f", max(tm) + to_seconds({FRESH}) AS expires_at",
                      source="(SELECT * FROM r WHERE t IN ('connect', 'fix') AND player_id IS NOT NULL)"))
