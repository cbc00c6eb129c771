"""Query registry: each entry is a Spark job over the given tables, mostly with an SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under its id; `sql` is what DuckDB runs on the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The document table, spread over the cores when it comes in few splits."""
    df = table(spark, sf_dir, "documents")
    return spread(df.select(*cols) if cols else df, "doc_id")


def pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = table(spark, sf_dir, "pages")
    return spread(df.select(*cols) if cols else df, "page_id")
