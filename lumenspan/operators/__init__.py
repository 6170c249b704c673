"""Operators on records."""
