"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineloom.plans import oracles, rule_oracles, rule_queries, table_queries, text_queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.f4_picks(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | table_queries.QUERIES | rule_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | rule_oracles.SQL
