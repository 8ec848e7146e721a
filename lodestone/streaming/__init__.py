"""Structured Streaming forms of event queries; each gives what its batch form gives."""

from lodestone.streaming.events import prompt_cache_stream, unit_digest

__all__ = ["prompt_cache_stream", "unit_digest"]
