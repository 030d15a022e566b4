"""Statements that change tables, and set operations."""
