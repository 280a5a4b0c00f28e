"""The event fold as set operators: players, lives, sessions, kills, hits, builds, fixes."""

from .fold import (
    PROJECTION_TABLES,
    Projections,
    aliases,
    builds,
    heartbeats,
    hits,
    kills,
    knockouts,
    lives,
    players,
    positions,
    rebuild,
    resolve_labels,
    sessions,
)

__all__ = [
    "PROJECTION_TABLES", "Projections",
    "aliases", "builds", "heartbeats", "hits", "kills", "knockouts", "lives", "players",
    "positions", "rebuild", "resolve_labels", "sessions",
]
