"""Structured Streaming forms of the live-monitor rules (ST1–ST3)."""
