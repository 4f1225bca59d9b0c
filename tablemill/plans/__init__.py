"""Whole runs: transfer, sync and document load, each reporting a RunResult."""
