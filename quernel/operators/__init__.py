"""Relational, vector and graph operators."""
