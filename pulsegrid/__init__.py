"""Telemetry analytics as Spark DataFrame transforms.

Every operator takes and returns DataFrames (or builds Column expressions), is
partitioned by an explicit entity key ``by`` and never looks at the wall clock.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
