"""Relational, window and graph operators."""
