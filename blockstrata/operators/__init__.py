"""Codecs as relational operators."""
