"""Sinks: lake tables and databases."""
