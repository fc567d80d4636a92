"""Relational operators over inventory tables."""
