"""Lists, thresholds and lookup tables that results depend on."""

from __future__ import annotations

# Emote label, log token, allowed in verification challenges.
EMOTES = [
    ("salute", "EmoteSalute", True),
    ("surrender", "EmoteSurrender", True),
    ("greeting", "EmoteGreeting", True),
    ("clap", "EmoteClap", True),
    ("heart", "EmoteHeart", True),
    ("point", "EmotePoint", True),
    ("point at self", "EmotePointSelf", True),
    ("thumbs up", "EmoteThumb", True),
    ("thumbs down", "EmoteThumbDown", True),
    ("nod head", "EmoteNod", True),
    ("shake head", "EmoteShake", True),
    ("dance", "EmoteDance", True),
    ("facepalm", "EmoteFacepalm", True),
    ("shrug", "EmoteShrug", True),
    ("timeout", "EmoteTimeout", True),
    ("look at me", "EmoteLookAtMe", True),
    ("listen", "EmoteListening", True),
    ("come", "EmoteCome", True),
    ("move", "EmoteMove", True),
    ("silent", "EmoteSilent", True),
    ("watching", "EmoteWatching", True),
    ("cut throat", "EmoteThroat", True),
    ("RPS", "EmoteRPSRandom", True),
    ("taunt elbow", "EmoteTauntElbow", True),
    ("suicide", "EmoteSuicide", False),
    ("vomit", "EmoteVomit", False),
    ("sit", "EmoteSitA", False),
]

# Weapon names counted as melee.
MELEE_WEAPONS = [
    "fists", "combat knife", "hunting knife", "kitchen knife", "steak knife", "kukri", "machete",
    "hatchet", "firefighter axe", "woodaxe", "wood axe", "ice axe", "pickaxe", "baseball bat",
    "sledgehammer", "hammer", "pipe wrench", "crowbar", "shovel", "field shovel", "farming hoe",
    "cattle prod", "stun baton", "brass knuckles", "screwdriver",
]

# Map code to world edge length in metres and to display label.
MAP_WORLD_SIZE = {"chernarusplus": 15360, "sakhal": 15360, "enoch": 12800}
MAP_LABELS = {"chernarusplus": "Chernarus", "sakhal": "Sakhal", "enoch": "Livonia"}

# Zoom from which a place kind is labelled; other kinds from 4.
PLACE_MIN_ZOOM = {"capital": 0, "city": 0, "village": 2}

# Rule thresholds.
QUALIFY_SECONDS = 300
RECENT_WINDOW_SECONDS = 120
ENCOUNTER_GAP_SECONDS = 120
FRESH_SECONDS = 900
THIN_METERS = 15.0
SURVIVORS_PAGE_SIZE = 25
PAST_LIVES_PAGE_SIZE = 10
OBITUARIES_PAGE_SIZE = 20
INBOX_PAGE_SIZE = 20
WALLET_ROWS = 50
RECENT_PROSE_ROWS = 12
MILESTONE_DAYS = [7, 14, 30]
LEGEND_KILLS = 20
LEGEND_SECONDS = 604_800
FRESH_SPAWN_SECONDS = 1_800
MAX_PUSH_FAILURES = 5
MAX_PURCHASE_QUANTITY = 100
