"""Sources: only queries run, and what a database source is asked for."""

import pytest

from turnwise.errors import AnalyticsError
from turnwise.sources.tables import jdbc_options, read_table, run_sql

REFUSED = [
    "DROP VIEW kept", "INSERT INTO kept VALUES (2)", "CREATE TABLE other AS SELECT 1 AS a", "SET a.b = c", "SHOW TABLES",
    "WITH q AS (SELECT 1) INSERT INTO kept SELECT * FROM q", "FROM kept INSERT INTO kept SELECT 1 INSERT INTO kept SELECT 2",
    "EXPLAIN SELECT 1", "CREATE OR REPLACE TEMP VIEW kept AS SELECT 3 AS a", "TRUNCATE TABLE kept", "CACHE TABLE kept",
]


@pytest.mark.parametrize("text", REFUSED)
def test_commands_are_refused_before_they_run(spark, text):
    spark.sql("SELECT 1 AS a").createOrReplaceTempView("kept")
    with pytest.raises(AnalyticsError) as error:
        run_sql(spark, text)
    assert error.value.code == "SQL_FORBIDDEN_STATEMENT"
    assert spark.table("kept").collect()[0].a == 1


@pytest.mark.parametrize("text", ["SELECT a FROM kept", "WITH q AS (SELECT a FROM kept) SELECT * FROM q", "VALUES (1)", "FROM kept SELECT a"])
def test_queries_run(spark, text):
    spark.sql("SELECT 1 AS a").createOrReplaceTempView("kept")
    assert run_sql(spark, text).collect()[0][0] == 1


def test_database_options():
    options = jdbc_options("jdbc:x:y", "t", "id", 1, 90, 8, {"user": "u", "dbtable": "other"})
    assert options == {
        "user": "u", "url": "jdbc:x:y", "dbtable": "t", "partitionColumn": "id", "lowerBound": "1", "upperBound": "90",
        "numPartitions": "8",
    }


def test_directories_keep_their_scheme(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, f"file://{tmp_path}/", "t").count() == 3
