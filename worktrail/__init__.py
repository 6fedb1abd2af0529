"""Work-event analytics on Spark: canonical events, signals, retrieval, scoring and audits."""

__version__ = "0.1.0"
