"""Structured Streaming versions of the stateful steps."""

from .dedupe import append_once, dedupe_stream
from .encounters import presence_spans, stream_encounters, stream_presence
from .projector import read_projection, run_projector
from .verify import stream_verify

__all__ = [
    "append_once", "dedupe_stream", "presence_spans", "read_projection", "run_projector", "stream_encounters",
    "stream_presence", "stream_verify",
]
