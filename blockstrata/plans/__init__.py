"""Snapshot store, history and pipelines."""
