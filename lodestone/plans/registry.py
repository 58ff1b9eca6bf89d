"""How query modules collect their queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone import reachable_by_workers

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with its SQL if there is any."""

        def add(f: Query) -> Query:
            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                reachable_by_workers(spark)
                return f(spark, sf_dir)

            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
