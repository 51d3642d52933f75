"""Operators that shape rows into aggregates."""
