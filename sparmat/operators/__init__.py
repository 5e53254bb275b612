"""Relational, statistical and interval operators."""
