"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Published times are UTC whatever the cluster's zone is.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, sf_dir)

        CHECKS[name] = Check(run, sql)
        return query

    return register
