"""Readers of the input tables and data sources."""
