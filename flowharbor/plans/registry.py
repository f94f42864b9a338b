"""Every registered query of the analytics engine with the SQL that it must agree with."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


for _module in ("flow_queries", "label_queries", "metric_queries", "token_queries", "memory_queries", "window_queries", "split_queries", "stream_queries", "report_queries", "primitive_queries", "profile_queries", "schema_queries", "job_queries"):
    import_module(f"flowharbor.plans.{_module}")
