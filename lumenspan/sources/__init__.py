"""Readers of vendor files."""
