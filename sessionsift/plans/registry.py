"""Registry of driver queries: name -> (spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionsift.session import ensure_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            ensure_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all():
    # Importing the query modules fills the registry.
    from sessionsift.plans import (  # noqa: F401
        queries_calls,
        queries_core,
        queries_ingest,
        queries_requests,
        queries_results,
        queries_stream,
    )
    return QUERIES, ORACLES
