"""Joins, windows and reports over sessions, channels and laps."""
