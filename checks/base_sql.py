"""Common table expressions every oracle query starts from (DuckDB dialect).

They restate the projections and side tables with plain window functions and as-of joins.
"""

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
SINCE = "TIMESTAMP '2024-01-10 00:00:00'"
QUALIFY, GAP, RECENT, FRESH = 43200, 21600, 21600, 43200


def seconds(start: str, end: str) -> str:
    """Whole non-negative seconds at millisecond precision."""
    return f"greatest(0, ((epoch_us({end}) // 1000) - (epoch_us({start}) // 1000)) // 1000)"


BASE = f"""
e AS (
  SELECT event_id, ts AS tm, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(1 + (user_id + event_id) % 3 AS INTEGER) AS server_id
  FROM events),
ev AS (
  SELECT *, 'P' || user_id AS label,
    CASE WHEN event_type = 'signup' THEN 'connect'
         WHEN event_type = 'purchase' AND k % 20 = 0 THEN 'boot'
         WHEN event_type = 'purchase' THEN 'leave'
         WHEN event_type = 'error' THEN 'die'
         WHEN event_type = 'view' AND k % 10 = 9 THEN 'down'
         WHEN event_type = 'view' AND k % 10 = 8 THEN 'build'
         WHEN event_type = 'view' THEN 'fix'
         ELSE 'hit' END AS t
  FROM e),
fc AS (SELECT user_id, min(event_id) AS player_id FROM ev WHERE t = 'connect' GROUP BY user_id),
r AS (
  SELECT ev.*, fc.player_id
  FROM ev LEFT JOIN fc ON fc.user_id = ev.user_id AND fc.player_id <= ev.event_id),
touch AS (SELECT player_id, event_id, tm FROM r
          WHERE t IN ('connect', 'leave', 'fix') AND player_id IS NOT NULL),
players AS (
  SELECT t.player_id, any_value(fc.user_id) AS user_id, 'P' || any_value(fc.user_id) AS gamertag,
         'H' || any_value(fc.user_id) AS dayz_id,
         arg_min(t.tm, t.event_id) AS first_seen_at, arg_max(t.tm, t.event_id) AS last_seen_at
  FROM touch t JOIN fc ON fc.player_id = t.player_id GROUP BY t.player_id),
lr0 AS (
  SELECT *, lag(t) OVER (PARTITION BY server_id, player_id ORDER BY event_id) AS prev_t
  FROM r WHERE t IN ('connect', 'die') AND player_id IS NOT NULL),
lr1 AS (SELECT *, t = 'die' AND coalesce(prev_t = 'connect', false) AS closes FROM lr0),
lr AS (
  SELECT *, CAST(1 + coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (
      PARTITION BY server_id, player_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS life_number
  FROM lr1),
bare AS (
  SELECT server_id, player_id, life_number,
         min(event_id) FILTER (WHERE t = 'connect') AS id,
         arg_min(tm, event_id) FILTER (WHERE t = 'connect') AS started_at,
         max(event_id) FILTER (WHERE closes) AS end_event_id
  FROM lr WHERE t = 'connect' OR closes GROUP BY ALL),
steps AS (
  SELECT server_id, player_id, event_id, tm, t, life_number FROM lr WHERE t = 'connect' OR closes
  UNION ALL
  SELECT server_id, player_id, event_id, tm, t, NULL FROM r WHERE t = 'leave' AND player_id IS NOT NULL),
stepped AS (
  SELECT *, lead(event_id) OVER w AS own_event, lead(tm) OVER w AS own_at, lead(t) OVER w AS own_t
  FROM steps WINDOW w AS (PARTITION BY server_id, player_id ORDER BY event_id)),
boots AS (SELECT server_id, event_id, tm FROM ev WHERE t = 'boot'),
closing AS (
  SELECT s.server_id, s.player_id, s.event_id AS id, s.tm AS connected_at, s.life_number,
    CASE WHEN b.event_id IS NOT NULL AND (s.own_event IS NULL OR b.event_id < s.own_event)
         THEN b.event_id ELSE s.own_event END AS close_event,
    CASE WHEN b.event_id IS NOT NULL AND (s.own_event IS NULL OR b.event_id < s.own_event)
         THEN b.tm ELSE s.own_at END AS close_at,
    CASE WHEN b.event_id IS NOT NULL AND (s.own_event IS NULL OR b.event_id < s.own_event) THEN 'reboot'
         WHEN s.own_t = 'connect' THEN 'superseded'
         WHEN s.own_t IS NOT NULL THEN 'clean' END AS close_reason
  FROM stepped s
  ASOF LEFT JOIN boots b ON b.server_id = s.server_id AND s.event_id < b.event_id
  WHERE s.t = 'connect'),
capped AS (
  SELECT c.*, h.tm AS beat
  FROM closing c
  ASOF LEFT JOIN touch h ON h.player_id = c.player_id AND c.close_event > h.event_id),
sessions AS (
  SELECT c.id, c.server_id, c.player_id, b.id AS life_id, c.connected_at,
    CASE WHEN c.close_reason = 'clean' THEN c.close_at
         WHEN c.close_reason IS NOT NULL THEN least(c.close_at, greatest(c.beat, c.connected_at)) END
      AS disconnected_at,
    c.close_reason
  FROM capped c JOIN bare b USING (server_id, player_id, life_number)),
sess AS (
  SELECT *, CASE WHEN disconnected_at IS NOT NULL
                 THEN {seconds('connected_at', 'disconnected_at')} END AS duration_seconds
  FROM sessions),
lives AS (
  SELECT b.id, b.server_id, b.player_id, b.life_number, b.started_at, d.tm AS ended_at,
    CASE WHEN d.k % 2 = 0 THEN 'pvp' WHEN d.k % 10 = 1 THEN 'suicide' WHEN d.k % 10 = 3 THEN 'bled_out'
         WHEN d.k % 10 = 5 THEN 'wolf' WHEN d.k % 10 = 7 THEN 'died'
         WHEN d.k IS NOT NULL THEN 'environment' END AS death_cause,
    CASE WHEN d.k % 2 = 0 THEN 'P' || (d.user_id + 1 + d.k % 5) END AS death_by_gamertag,
    CASE WHEN d.k % 2 = 0 THEN CASE d.k % 3 WHEN 0 THEN 'M4A1' WHEN 1 THEN 'Hunting Knife' ELSE 'SKS' END END
      AS death_weapon,
    CASE WHEN d.k % 2 = 0 THEN d.value END AS death_distance,
    CASE WHEN d.k % 2 = 1 THEN CAST(d.k % 4 AS DOUBLE) END AS energy_at_death,
    CASE WHEN d.k % 2 = 1 THEN CAST(d.k % 6 AS DOUBLE) END AS water_at_death,
    CASE WHEN d.k % 2 = 1 THEN d.k % 3 END AS bleed_sources_at_death,
    CAST(coalesce((SELECT sum(duration_seconds) FROM sess s WHERE s.life_id = b.id), 0) AS BIGINT)
      AS playtime_seconds,
    b.end_event_id
  FROM bare b LEFT JOIN ev d ON d.event_id = b.end_event_id),
named AS (
  SELECT l.*, p.gamertag, p.dayz_id, p.user_id, p.first_seen_at, p.last_seen_at
  FROM lives l JOIN players p USING (player_id)),
kills AS (
  SELECT v.server_id, 'P' || (v.user_id + 1 + v.k % 5) AS killer_gamertag,
         kf.player_id AS killer_player_id, v.label AS victim_gamertag, v.player_id AS victim_player_id,
         b.id AS victim_life_id,
         CASE v.k % 3 WHEN 0 THEN 'M4A1' WHEN 1 THEN 'Hunting Knife' ELSE 'SKS' END AS weapon,
         v.value AS distance, v.tm AS occurred_at, v.event_id
  FROM lr v
  JOIN bare b USING (server_id, player_id, life_number)
  LEFT JOIN fc kf ON kf.user_id = v.user_id + 1 + v.k % 5 AND kf.player_id < v.event_id
  WHERE v.closes AND v.k % 2 = 0),
hits AS (
  SELECT event_id, server_id, label AS victim_gamertag, player_id AS victim_player_id, value AS victim_hp,
    CASE k % 3 WHEN 0 THEN 'player' WHEN 1 THEN 'infected' ELSE 'environment' END AS attacker_type,
    CASE WHEN k % 3 = 0 THEN 'P' || (user_id + 1 + k % 5) END AS attacker_gamertag,
    CASE WHEN k % 3 = 1 THEN 'Infected'
         WHEN k % 3 = 2 THEN CASE k % 5 WHEN 0 THEN 'FireplaceBase' WHEN 1 THEN 'Animal_CanisLupus_Grey'
           WHEN 2 THEN 'FallDamageHealth' WHEN 3 THEN 'Animal_UrsusArctos' ELSE 'BarbedWire' END END
      AS attacker_label,
    CASE WHEN k % 4 <> 0 THEN 'Torso' END AS body_part, tm AS occurred_at
  FROM r WHERE t = 'hit'),
fixes AS (
  SELECT event_id, server_id, player_id, label AS gamertag, value * 30 AS x, CAST(k * 150 AS DOUBLE) AS y,
         tm AS recorded_at
  FROM r WHERE t = 'fix' AND player_id IS NOT NULL),
downs AS (
  SELECT server_id, player_id, label AS gamertag, k % 20 = 9 AS disconnecting, tm AS occurred_at
  FROM r WHERE t = 'down' AND player_id IS NOT NULL),
builds AS (
  SELECT r.event_id, r.server_id, r.label AS gamertag, r.player_id,
         (SELECT max(l.id) FROM lives l WHERE l.server_id = r.server_id AND l.player_id = r.player_id
            AND l.started_at <= r.tm AND (l.ended_at IS NULL OR l.ended_at > r.tm)) AS life_id,
         'placed' AS action, 'Fence' || (r.k % 7) AS object, r.tm AS occurred_at
  FROM r WHERE t = 'build'),
servers AS (
  SELECT DISTINCT server_id AS id, 'Server ' || server_id AS name,
    CASE server_id WHEN 1 THEN 'chernarusplus' WHEN 2 THEN 'sakhal' ELSE 'enoch' END AS map,
    CASE server_id WHEN 1 THEN 'chernarus' WHEN 2 THEN 'sakhal' ELSE 'livonia' END AS slug,
    server_id <> 3 AS active
  FROM e),
links AS (
  SELECT user_id AS id, 'U' || user_id AS user_id,
         (CASE WHEN user_id % 2 = 0 THEN 'P' ELSE 'p' END) || user_id AS gamertag,
         CASE WHEN user_id % 4 = 0 THEN 'pending' ELSE 'verified' END AS status,
         CASE WHEN user_id % 4 <> 0 THEN min(tm) + INTERVAL 1 HOUR END AS verified_at,
         min(tm) AS created_at
  FROM e GROUP BY e.user_id),
avatars AS (SELECT user_id, 'h' || id AS hash FROM links WHERE id % 3 <> 0),
bans AS (
  SELECT id, server_id, gamertag, dayz_id, started_at AS life_started_at, ended_at AS banned_at,
         ended_at + INTERVAL 24 HOUR AS expires_at,
         CASE (id // 2) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'lift_pending'
              WHEN 3 THEN 'expired' ELSE 'lifted' END AS status,
         id % 7 = 0 AS dry_run,
         CASE WHEN (id // 2) % 5 >= 3 THEN ended_at + INTERVAL 24 HOUR END AS lifted_at,
         ended_at AS created_at
  FROM named WHERE ended_at IS NOT NULL AND id % 2 = 0),
articles AS (
  SELECT l.id, 'obituary' AS kind, CASE WHEN l.id % 9 = 0 THEN 'failed' ELSE 'published' END AS status,
         'obit-' || l.id AS slug, l.server_id,
         CASE WHEN l.id % 30 <> 0 THEN l.gamertag END AS gamertag, s.map, s.slug AS map_slug, l.life_number,
         l.started_at AS life_started_at, l.ended_at AS death_at, 'Death of ' || l.gamertag AS headline,
         'Life ' || l.life_number || ' is over. It counted.' AS lede,
         l.playtime_seconds AS time_alive_seconds, l.death_cause AS cause, l.death_by_gamertag,
         CAST(l.id % 5 AS INTEGER) AS attempts, l.ended_at + INTERVAL 1 HOUR AS created_at
  FROM named l JOIN servers s ON s.id = l.server_id
  WHERE l.ended_at IS NOT NULL AND l.id % 3 = 0),
syndications AS (
  SELECT slug, CASE WHEN id % 4 = 0 THEN 'chat' ELSE 'social' END AS channel,
         CASE WHEN id % 8 <> 0 THEN created_at END AS posted_at, CAST(id % 4 AS INTEGER) AS attempts
  FROM articles WHERE id % 2 = 0),
shares AS (
  SELECT 'U' || p.user_id AS granter_user_id, 'U' || (p.user_id + 1) AS grantee_user_id, s.server_id,
         max(s.connected_at) AS granter_session_connected_at
  FROM sessions s JOIN players p USING (player_id) WHERE s.id % 2 = 0 GROUP BY p.user_id, s.server_id),
notifications AS (
  SELECT event_id AS id, 'U' || user_id AS user_id, event_type AS kind,
         event_type || ':' || user_id || ':' || k AS natural_key, tm AS created_at,
         CASE WHEN k % 2 = 0 THEN tm END AS read_at, CASE WHEN k % 3 = 0 THEN tm END AS pushed_at
  FROM e),
subscriptions AS (
  SELECT id, user_id, 'https://push/' || id AS endpoint, CAST(id % 6 AS INTEGER) AS failure_count,
         CASE WHEN id % 5 = 0 THEN created_at END AS disabled_at
  FROM links WHERE id % 3 = 0),
ledger AS (
  SELECT o_orderkey AS id, 'C' || o_custkey AS user_id, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END AS delta,
         CASE o_orderstatus WHEN 'P' THEN 'redeem' WHEN 'F' THEN 'monthly' ELSE 'verification' END AS kind,
         'verify:' || o_orderkey AS idempotency_key, o_orderdate AS created_at
  FROM orders),
claims AS (
  SELECT c_custkey AS id, 'C' || c_custkey AS user_id, c_name AS gamertag,
         CASE WHEN c_acctbal > 0 THEN 'verified' ELSE 'pending' END AS status
  FROM customer),
referrals AS (
  SELECT 'C' || c_custkey AS user_id, 'C' || (c_custkey % 50) AS referrer_user_id FROM customer),
prose AS (
  SELECT d.doc_id AS id, d.source AS kind, CASE WHEN l.quality = 1 THEN 'published' ELSE 'failed' END AS status,
         d.text, d.lang, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at
  FROM documents d LEFT JOIN labels l USING (doc_id)),
live AS (SELECT * FROM servers WHERE active AND slug IS NOT NULL),
life_kills AS (
  SELECT l.id AS life_id, k.* FROM kills k
  JOIN lives l ON l.server_id = k.server_id AND l.player_id = k.killer_player_id
   AND k.occurred_at >= l.started_at AND (l.ended_at IS NULL OR k.occurred_at <= l.ended_at)),
label_kills AS (
  SELECT l.id AS life_id, k.* FROM kills k
  JOIN named l ON l.server_id = k.server_id AND l.gamertag = k.killer_gamertag
   AND k.occurred_at >= l.started_at AND (l.ended_at IS NULL OR k.occurred_at <= l.ended_at)),
open_sess AS (SELECT life_id AS id, connected_at FROM sessions WHERE disconnected_at IS NULL),
status0 AS (
  SELECT n.*, o.connected_at, coalesce(n.last_seen_at, o.connected_at, {NOW}) AS up_to
  FROM named n LEFT JOIN open_sess o USING (id)),
status1 AS (
  SELECT *, CASE WHEN ended_at IS NOT NULL OR connected_at IS NULL THEN playtime_seconds
                 ELSE playtime_seconds + {seconds('connected_at', 'up_to')} END AS seconds
  FROM status0),
lk AS (SELECT life_id AS id, count(*) AS kills, min(occurred_at) AS first_kill_at,
              max(distance) AS longest_kill_meters FROM life_kills GROUP BY life_id),
lkc AS (SELECT k.life_id AS id, count(*) AS kills_counted
        FROM life_kills k JOIN status1 s ON s.id = k.life_id
        WHERE k.occurred_at <= coalesce(s.ended_at, s.up_to) GROUP BY k.life_id),
status AS (
  SELECT s.*, coalesce(lk.kills, 0) AS kills, lk.first_kill_at, lk.longest_kill_meters,
         coalesce(lkc.kills_counted, 0) AS kills_counted,
         coalesce(s.death_cause = 'pvp', false) OR coalesce(lkc.kills_counted, 0) > 0
           OR s.seconds >= {QUALIFY} AS qualified
  FROM status1 s LEFT JOIN lk USING (id) LEFT JOIN lkc USING (id)),
sess_share AS (
  SELECT s.*, CASE WHEN s.disconnected_at IS NOT NULL THEN s.duration_seconds
                   ELSE {seconds('s.connected_at', 'p.last_seen_at')} END AS share, p.last_seen_at
  FROM sess s JOIN players p USING (player_id)),
sess_clock AS (
  SELECT *, coalesce(sum(share) OVER (PARTITION BY life_id ORDER BY connected_at, id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sess_share),
qcand AS (
  SELECT id AS life_id, ended_at AS tm, 0 AS rank FROM lives WHERE death_cause = 'pvp'
  UNION ALL SELECT life_id, min(occurred_at), 1 FROM life_kills GROUP BY life_id
  UNION ALL SELECT life_id, connected_at + to_seconds(CAST({QUALIFY} - before AS BIGINT)), 2 FROM sess_clock
            WHERE before < {QUALIFY} AND before + share >= {QUALIFY}),
qat AS (
  SELECT life_id, tm AS qualified_at,
         CASE rank WHEN 0 THEN 'pvp-death' WHEN 1 THEN 'kill' ELSE 'playtime' END AS qualified_by
  FROM (SELECT *, row_number() OVER (PARTITION BY life_id ORDER BY tm, rank) AS rn FROM qcand) WHERE rn = 1),
life_hits AS (
  SELECT n.id AS life_id, n.ended_at, n.started_at, h.* FROM hits h
  JOIN named n ON n.server_id = h.server_id AND n.player_id = h.victim_player_id
   AND h.occurred_at >= n.started_at AND h.occurred_at <= coalesce(n.ended_at, n.last_seen_at, {NOW})),
dossier_hits AS (
  SELECT *, coalesce(ended_at, started_at) AS window_end FROM life_hits
  WHERE occurred_at <= coalesce(ended_at, started_at)),
aged AS (
  SELECT *, CAST(floor(((epoch_us(window_end) // 1000) - (epoch_us(occurred_at) // 1000)) / 1000.0 + 0.5) AS BIGINT) AS age
  FROM dossier_hits),
evid AS (
  SELECT life_id, count(*) AS recent_hits,
         count(*) FILTER (WHERE attacker_type = 'infected') AS recent_infected_hits,
         min(victim_hp) FILTER (WHERE attacker_type = 'infected') AS infected_hp_low,
         count(*) FILTER (WHERE attacker_label LIKE 'FallDamage%' AND victim_hp <= 0) AS fatal_falls
  FROM aged WHERE age BETWEEN 0 AND {RECENT} GROUP BY life_id),
down_ev AS (
  SELECT l.id AS life_id, count(*) AS recent_knockouts
  FROM downs d JOIN lives l ON l.server_id = d.server_id AND l.player_id = d.player_id
   AND d.occurred_at >= l.started_at AND d.occurred_at <= coalesce(l.ended_at, l.started_at)
  WHERE floor(((epoch_us(coalesce(l.ended_at, l.started_at)) // 1000) - (epoch_us(d.occurred_at) // 1000)) / 1000.0 + 0.5) <= {RECENT}
  GROUP BY l.id),
cat AS (
  SELECT *, CASE WHEN lower(coalesce(attacker_label, '')) LIKE '%fire%' THEN 'fire'
                 WHEN attacker_type = 'infected' THEN 'infected'
                 WHEN attacker_type = 'player' THEN 'pvp' END AS ordeal
  FROM dossier_hits),
runs0 AS (
  SELECT *, CASE WHEN epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER w) > {GAP} * CAST(1000000 AS BIGINT)
                   OR lag(occurred_at) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM cat WHERE ordeal IS NOT NULL
  WINDOW w AS (PARTITION BY life_id, ordeal ORDER BY occurred_at, event_id)),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY life_id, ordeal ORDER BY occurred_at, event_id) AS encounter FROM runs0),
ordeals AS (
  SELECT life_id, ordeal, count(*) AS encounters, CAST(sum(n) AS BIGINT) AS hits, max(n) AS worst
  FROM (SELECT life_id, ordeal, encounter, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL),
facts AS (
  SELECT l.*, coalesce(ev2.recent_hits, 0) AS recent_hits,
         coalesce(ev2.recent_infected_hits, 0) AS recent_infected_hits, ev2.infected_hp_low,
         coalesce(ev2.fatal_falls, 0) AS fatal_falls, coalesce(d.recent_knockouts, 0) AS recent_knockouts,
         coalesce(l.energy_at_death <= 1, false) AS starving, coalesce(l.water_at_death <= 1, false) AS parched,
         coalesce(ev2.recent_infected_hits, 0) > 0 AS hunted,
         coalesce(l.bleed_sources_at_death > 0, false) AS bleeding,
         coalesce(ev2.infected_hp_low <= 1, false) AS terminal
  FROM lives l LEFT JOIN evid ev2 ON ev2.life_id = l.id LEFT JOIN down_ev d ON d.life_id = l.id),
verdict0 AS (
  SELECT *,
    CASE WHEN ended_at IS NULL THEN NULL
         WHEN death_cause = 'environment' THEN 'environmental'
         WHEN death_cause IN ('pvp', 'suicide', 'bled_out', 'wolf') THEN death_cause
         WHEN fatal_falls > 0 THEN 'fall' WHEN starving THEN 'starvation' WHEN parched THEN 'dehydration'
         WHEN hunted AND (bleeding OR recent_knockouts > 0 OR terminal) THEN 'mauled'
         WHEN bleeding AND recent_hits > 0 THEN 'bled_out'
         ELSE 'unknown' END AS verdict_cause,
    array_to_string(list_filter([CASE WHEN starving THEN 'starving' END, CASE WHEN parched THEN 'dehydrated' END,
      CASE WHEN hunted THEN 'hunted' END], lambda x: x IS NOT NULL), ',') AS base
  FROM facts),
verdicts AS (
  SELECT *,
    CASE WHEN ended_at IS NULL THEN NULL WHEN verdict_cause = 'unknown' THEN 'low'
         WHEN verdict_cause IN ('starvation', 'dehydration') AND recent_hits > 0 THEN 'low'
         ELSE 'high' END AS verdict_confidence,
    CASE WHEN ended_at IS NULL THEN NULL
         WHEN death_cause = 'bled_out' OR (death_cause = 'died' AND bleeding
              AND verdict_cause IN ('mauled', 'bled_out'))
           THEN CASE WHEN base = '' THEN 'bleeding' ELSE base || ',bleeding' END
         WHEN base = '' THEN 'healthy' ELSE base END AS verdict_conditions
  FROM verdict0),
enc0 AS (
  SELECT life_id, ended_at, occurred_at, event_id, victim_hp, attacker_gamertag,
    CASE WHEN lower(coalesce(attacker_label, '')) LIKE '%fire%' THEN 'fire'
         WHEN attacker_type = 'infected' THEN 'infected' WHEN attacker_type = 'player' THEN 'player'
         WHEN attacker_label LIKE 'Animal\\_CanisLupus%' ESCAPE '\\' THEN 'wolf'
         WHEN attacker_label LIKE 'Animal\\_UrsusArctos%' ESCAPE '\\' THEN 'bear'
         ELSE 'environment' END AS category,
    CASE WHEN attacker_type = 'player' THEN lower(attacker_gamertag) ELSE '' END AS attacker
  FROM life_hits),
enc1 AS (
  SELECT *, CASE WHEN epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER w) > {GAP} * CAST(1000000 AS BIGINT)
                   OR lag(occurred_at) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM enc0 WINDOW w AS (PARTITION BY life_id, category, attacker ORDER BY occurred_at, event_id)),
enc2 AS (
  SELECT *, sum(opens) OVER (PARTITION BY life_id, category, attacker ORDER BY occurred_at, event_id) AS n FROM enc1),
enc3 AS (
  SELECT life_id, category, attacker, n, any_value(ended_at) AS ended_at, min(occurred_at) AS started_at,
         max(occurred_at) AS last_at, arg_min(attacker_gamertag, event_id) AS first_attacker,
         count(*) AS hits, min(victim_hp) AS hp_low
  FROM enc2 GROUP BY life_id, category, attacker, n),
encounters AS (
  SELECT life_id, category, CASE WHEN category = 'player' THEN first_attacker END AS attacker_gamertag, started_at,
         CAST(floor(((epoch_us(last_at) // 1000) - (epoch_us(started_at) // 1000)) / 1000.0 + 0.5) AS BIGINT) AS duration_seconds,
         hits, hp_low
  FROM enc3
  WHERE ended_at IS NULL OR NOT ((epoch_us(ended_at) // 1000) - (epoch_us(last_at) // 1000)) / 1000.0 <= {RECENT})
"""


def with_base(query: str, extra: str = "") -> str:
    return f"WITH {BASE}{',' + extra if extra else ''} {query}"
