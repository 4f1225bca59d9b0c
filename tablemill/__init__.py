"""tablemill: move, reconcile, load, profile and scrub tables as Spark jobs.

Operators take and return DataFrames; the ``plans`` package strings them into
whole runs (transfer, sync, document load) that report a ``RunResult``.
"""

__version__ = "0.1.0"
