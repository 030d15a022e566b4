"""Catalog and versioned tables."""
