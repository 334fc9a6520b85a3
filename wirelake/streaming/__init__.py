"""Structured Streaming over decoded payloads."""

from .windows import decode_stream, last_by_key, windowed

__all__ = ["decode_stream", "last_by_key", "windowed"]
