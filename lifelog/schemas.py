"""Table schemas: the event log, its projections and the durable side tables."""

from __future__ import annotations

# The closed event vocabulary.
EVENT_TYPES = [
    "player.connecting",
    "player.connected",
    "player.disconnected",
    "player.died",
    "player.hit",
    "player.unconscious",
    "emote.performed",
    "build.placed",
    "build.built",
    "build.dismantled",
    "build.packed",
    "build.repaired",
    "player.teleported",
    "player.position",
    "server.rebooted",
    "roster.snapshot",
]

BUILD_TYPES = [t for t in EVENT_TYPES if t.startswith("build.")]

# The columns of the event log and of the durable tables.
EVENTS = (
    "event_id long, server_id int, file_id long, line_index int, sub_index int, type string, "
    "occurred_at timestamp, payload string, raw_line_id long"
)

# Union of the payload fields of all event types, as stored in the JSON payload.
PAYLOAD = (
    "gamertag string, dayzId string, victim string, cause string, killer string, weapon string, "
    "distance double, energy double, water double, bleedSources int, deathEntity string, "
    "victimHp double, attackerType string, attackerGamertag string, attackerLabel string, "
    "damage double, bodyPart string, x double, y double, disconnecting boolean, action string, "
    "object string, className string, tool string, emote string, item string, count int, "
    "localDateTime string, reason string, `from` array<double>, `to` array<double>"
)

TABLES = {
    "servers": "id int, name string, map string, slug string, active boolean, clock_offset_ms long",
    "players": "id long, gamertag string, dayz_id string, first_seen_at timestamp, last_seen_at timestamp",
    "player_gamertags": (
        "player_id long, gamertag string, first_seen_at timestamp, last_seen_at timestamp"
    ),
    "lives": (
        "id long, server_id int, player_id long, life_number int, started_at timestamp, "
        "ended_at timestamp, death_cause string, death_by_gamertag string, death_weapon string, "
        "death_distance double, energy_at_death double, water_at_death double, "
        "bleed_sources_at_death int, playtime_seconds long"
    ),
    "sessions": (
        "id long, server_id int, player_id long, life_id long, connected_at timestamp, "
        "disconnected_at timestamp, duration_seconds long, close_reason string"
    ),
    "kills": (
        "server_id int, killer_gamertag string, killer_player_id long, victim_gamertag string, "
        "victim_player_id long, victim_life_id long, weapon string, distance double, "
        "occurred_at timestamp"
    ),
    "hit_events": (
        "server_id int, victim_gamertag string, victim_player_id long, attacker_gamertag string, "
        "attacker_type string, attacker_label string, body_part string, victim_hp double, x double, "
        "y double, occurred_at timestamp"
    ),
    "build_events": (
        "server_id int, gamertag string, player_id long, life_id long, action string, object string, "
        "class_name string, tool string, x double, y double, occurred_at timestamp"
    ),
    "positions": (
        "server_id int, player_id long, gamertag string, x double, y double, recorded_at timestamp"
    ),
    "unconscious_events": (
        "server_id int, player_id long, gamertag string, disconnecting boolean, occurred_at timestamp"
    ),
    "gamertag_links": (
        "id long, user_id string, gamertag string, status string, verified_at timestamp, "
        "created_at timestamp"
    ),
    "verification_challenges": (
        "id long, gamertag_link_id long, sequence array<string>, progress_index int, "
        "last_matched_event_id long, issued_at timestamp, expires_at timestamp, completed_at timestamp"
    ),
    "bans": (
        "id long, server_id int, gamertag string, dayz_id string, life_started_at timestamp, "
        "qualified_by string, banned_at timestamp, expires_at timestamp, status string, "
        "dry_run boolean, lifted_at timestamp, created_at timestamp"
    ),
    "token_transactions": (
        "id long, user_id string, delta int, kind string, idempotency_key string, "
        "related_ban_id long, created_at timestamp"
    ),
    "referrals": "user_id string, referrer_user_id string, created_at timestamp",
    "articles": (
        "id long, kind string, status string, slug string, server_id int, gamertag string, "
        "map string, map_slug string, life_number int, life_started_at timestamp, "
        "death_at timestamp, headline string, lede string, body string, tags array<string>, "
        "time_alive_seconds long, kills int, longest_kill_meters double, cause string, "
        "pull_quote_text string, pull_quote_attribution string, facts string, body_blocks string, "
        "attempts int, created_at timestamp"
    ),
    "notifications": (
        "id long, user_id string, kind string, natural_key string, title string, body string, "
        "href string, created_at timestamp, read_at timestamp, pushed_at timestamp"
    ),
    "push_subscriptions": (
        "id long, user_id string, endpoint string, failure_count int, disabled_at timestamp"
    ),
    "location_shares": (
        "granter_user_id string, grantee_user_id string, server_id int, "
        "granter_session_connected_at timestamp"
    ),
    "syndications": "slug string, channel string, posted_at timestamp, attempts int",
    "avatars": "user_id string, hash string",
}
