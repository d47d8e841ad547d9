"""Every registered query with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import answers, evaluation, labels, retrieval, reviews, service, store, streams, text

FLAGSHIP = "rrf_pinned_top5"
_ALL = {**retrieval.QUERIES, **store.QUERIES, **text.QUERIES, **service.QUERIES, **evaluation.QUERIES, **streams.QUERIES, **reviews.QUERIES, **answers.QUERIES, **labels.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
