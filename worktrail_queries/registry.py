from __future__ import annotations

import functools
from collections.abc import Callable

from worktrail.session import prepare_tables
from worktrail_queries.sqlkit import expand

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. ``sql`` may use the shared table expressions of sqlkit by name."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            prepare_tables(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return add


def load_all() -> None:
    import importlib

    for module in ("events_q", "signals_q", "windows_q", "mining_q", "functions_q", "gold_q", "retrieval_q", "scoring_q",
                   "annotation_q", "checks_q", "audits_q", "sources_q", "reports_q", "streams_q"):
        try:
            importlib.import_module(f"worktrail_queries.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"worktrail_queries.{module}":
                raise
