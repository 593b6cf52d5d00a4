"""Readers, writers and the session catalog."""
