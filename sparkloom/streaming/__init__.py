"""Structured Streaming: the engine's tables as streams of files."""
