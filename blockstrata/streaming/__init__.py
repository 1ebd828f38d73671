"""Incremental snapshots of arriving files."""
