"""The registered queries: each runs an operator over the given tables and, where
plain SQL can say the same, carries that SQL as its check."""

from worktrail_queries.registry import ORACLES, QUERIES  # noqa: F401
