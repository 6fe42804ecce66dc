"""airmetrics: flight-operations analytics expressed as Spark DataFrame jobs.

Layout
------
sources/    readers, writers and the driver-table fixtures
functions/  column expressions for cleaning (no UDFs)
operators/  DataFrame -> DataFrame operators: modelling, profiling, filters,
            charts, joins, histogram, LOWESS, distributed scans, SQL gate
plans/      multi-operator jobs: the dashboard, the delay model, the query catalog
streaming/  position-message stream (batch and Structured Streaming forms)
"""

__all__ = ["session"]
