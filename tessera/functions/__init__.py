"""Aggregates and scalar functions."""
