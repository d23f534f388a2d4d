"""How a query module registers its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """t.lineitem and so on: the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
