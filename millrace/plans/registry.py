"""Registered queries over the dataset tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


from millrace.plans import call_queries, conversion_queries, dedup_queries, exchange_queries, journal_queries, merge_queries, metric_queries, ordered_queries, partition_queries, record_queries, rule_queries, schedule_queries, score_queries, similarity_queries, witness_queries  # noqa: E402,F401
