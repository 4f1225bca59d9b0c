"""Scans: queries, databases, documents and records."""
