"""Readers of metric payloads and of tables."""
