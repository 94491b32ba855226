"""Structured Streaming: sources, stateful operators and continuous ingestion."""
