"""All queries by name, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopweave.queries import evaluation, graphs, inputs, retrieval, steps, texts

ALL = texts.QUERIES | graphs.QUERIES | retrieval.QUERIES | evaluation.QUERIES | inputs.QUERIES | steps.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_first_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
