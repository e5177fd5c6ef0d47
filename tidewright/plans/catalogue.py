"""All registered queries of the library, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import augmentation, certify, checks, credit, episodes, grading, nested, planning, records, runs, selection, sources, states, tasks, text, turns, values

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {**credit.QUERIES, **episodes.QUERIES, **text.QUERIES, **selection.QUERIES, **grading.QUERIES, **certify.QUERIES, **turns.QUERIES, **states.QUERIES, **checks.QUERIES, **runs.QUERIES, **values.QUERIES, **records.QUERIES, **tasks.QUERIES, **planning.QUERIES, **augmentation.QUERIES, **nested.QUERIES, **sources.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
