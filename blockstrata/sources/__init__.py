"""Formats: tag trees, region containers, files and their connectors."""
