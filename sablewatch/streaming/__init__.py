"""Structured Streaming: sources, sinks, stateful operators and complete jobs."""
