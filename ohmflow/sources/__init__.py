"""Readers, derived fixture views and sinks."""
