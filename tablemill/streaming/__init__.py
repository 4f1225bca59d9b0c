"""Incremental forms of transfer, sync and log scrubbing."""
