"""roadglass: a Spark-first analytics engine for spatiotemporal records."""

__version__ = "0.1.0"
