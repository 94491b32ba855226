"""Readers of raw log lines."""
