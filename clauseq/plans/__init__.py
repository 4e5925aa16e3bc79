"""Stored tables: versions of rows by key."""
