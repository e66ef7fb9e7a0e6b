"""Readers, writers and upserts."""
