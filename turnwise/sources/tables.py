"""Table sources: parquet directories and JDBC tables, registered as views for SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from turnwise.errors import AnalyticsError

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, directory: str, names: Sequence[str] = TABLES) -> None:
    """Make tables available to SQL under their own names."""
    for name in names:
        read_table(spark, directory, name).createOrReplaceTempView(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Read a database table with one range of ``partition_column`` per task."""
    options = jdbc_options(url, table, partition_column, lower, upper, partitions, properties)
    return spark.read.format("jdbc").options(**options).load()


def jdbc_options(
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """The options of :func:`read_jdbc`; ``properties`` cannot replace the others."""
    return {
        **(properties or {}),
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a query over the registered tables; the result is lazy and has no row cap.

    Spark's own parser reads the text first, and anything that holds a command is refused before
    it runs: definitions, writes, settings, and listings alike.
    """
    if command := _command(spark, text):
        raise AnalyticsError(
            "SQL_FORBIDDEN_STATEMENT", "only queries are allowed", {"statement_type": command}
        )
    return spark.sql(text)


def _command(spark: SparkSession, text: str) -> str | None:
    """The name of the first command or statement in the parsed text that is not a query."""
    load = spark._jvm.java.lang.Class.forName
    package = "org.apache.spark.sql.catalyst.plans.logical."
    refused = [load(package + name) for name in ("Command", "ParsedStatement")]
    plans = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while plans:
        plan = plans.pop()
        if any(kind.isInstance(plan) for kind in refused):
            return plan.nodeName()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return None
