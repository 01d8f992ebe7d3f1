"""Registration of queries next to their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnwise.session import configure
from turnwise.sources.tables import TABLES, read_table, register_tables, run_sql


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


class Tables:
    """The tables of one directory, read on first use."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


REGISTRY: dict[str, Registered] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Tables` as a query."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Tables(configure(spark), directory))

        REGISTRY[name] = Registered(run, oracle)
        return build

    return register


def sql_query(name: str, text: str) -> None:
    """Register SQL that reads the same in both engines."""

    used = [table for table in TABLES if re.search(rf"\b{table}\b", text)]

    def run(spark: SparkSession, directory: str) -> DataFrame:
        register_tables(configure(spark), directory, used)
        return run_sql(spark, text)

    REGISTRY[name] = Registered(run, text)
