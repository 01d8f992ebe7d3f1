"""Row numbers that go on: appended rows are numbered after those that are saved, and a page opens only what it shows.

A saved table holds one folder per batch of appended rows, with folders of ``BLOCK_ROWS`` numbers inside, and a table of batches with the first
number, the count and the columns of each. A batch is numbered by itself, so an append reads no row that was saved before, only the counts. The
table of batches is written last: rows of an append that broke off are in no batch, and the next append writes in their place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnwise.errors import AnalyticsError
from turnwise.operators.positions import SortKey
from turnwise.operators.shape import number_rows

#: Numbers in one folder of rows.
BLOCK_ROWS = 1 << 22
_BLOCK = "__tw_block"
_BATCHES = "batch bigint, first bigint, n bigint, columns string"


def _batches(spark: SparkSession, directory: str) -> DataFrame:
    """(batch, first number, count, columns with the numbers) of the appends so far; none where nothing is saved."""
    try:
        return spark.read.schema(_BATCHES).parquet(f"{directory}/batches")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _BATCHES)


def _place(directory: str, batch: int) -> str:
    return f"{directory}/rows/batch={batch}"


def append_numbered(df: DataFrame, order: Sequence[SortKey], directory: str, name: str = "row_no", max_rows: int | None = None) -> int:
    """Number rows in a total order, from one more than the last number saved, save them, and return how many are saved now.

    The numbers are those of the whole table sorted by (append, ``order``). All appends must have the same columns (AnalyticsError
    ``APPEND_COLUMNS_DIFFER``) and none called ``name`` (``NAME_TAKEN``). One writer at a time. An empty append leaves the numbers
    as they are. A single row of sums passes through the driver.
    """
    spark = df.sparkSession
    if name.lower() in {c.lower() for c in df.columns}:
        raise AnalyticsError("NAME_TAKEN", "the column of numbers must not be in the table", {"column": name})
    sums = _batches(spark, directory).agg(F.max("batch").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("columns").alias("columns")).first()
    batch, saved = (0 if sums["last"] is None else sums["last"] + 1), sums["n"]
    numbered = number_rows(df, order, name, max_rows).withColumn(name, F.col(name).cast("bigint") + F.lit(saved))
    columns = StructType([StructField(f.name, f.dataType) for f in numbered.schema.fields])
    if batch and StructType.fromJson(json.loads(sums["columns"])).simpleString() != columns.simpleString():
        raise AnalyticsError("APPEND_COLUMNS_DIFFER", "appended rows must have the columns of the saved ones", {"appended": columns.simpleString()})
    # Sorted by number, so that of a block only the parts of a file that hold a page are read.
    dealt = numbered.withColumn(_BLOCK, _block(F.col(name))).hint("rebalance", _BLOCK).sortWithinPartitions(_BLOCK, name)
    dealt.write.mode("overwrite").partitionBy(_BLOCK).parquet(_place(directory, batch))
    count = _rows(spark, directory, [batch], columns).count()
    entry = spark.createDataFrame([(batch, saved + 1, count, columns.json())], _BATCHES).coalesce(1)
    entry.write.mode("append").parquet(f"{directory}/batches")
    return saved + count


def _block(number: Column) -> Column:
    return F.floor((number - F.lit(1)) / F.lit(BLOCK_ROWS)).cast("bigint")


def _rows(spark: SparkSession, directory: str, batches: Sequence[int], columns: StructType) -> DataFrame:
    """The rows of some batches, with the numbers of their blocks."""
    columns = StructType([*columns.fields, StructField(_BLOCK, LongType())])
    if not batches:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).option("basePath", f"{directory}/rows").parquet(*[_place(directory, b) for b in batches])


def read_numbered(spark: SparkSession, directory: str, first: int | None = None, count: int | None = None, name: str = "row_no") -> DataFrame:
    """The saved rows with their numbers; with ``first`` and ``count`` those numbered ``first`` to ``first + count - 1``.

    Only the batches and blocks that hold such numbers are opened. Numbers outside the table give an empty result, so does a page of no rows;
    nothing saved raises AnalyticsError ``NOTHING_SAVED``. The batches of the page (a row each) pass through the driver.
    """
    found = _batches(spark, directory)
    low = 1 if first is None else first
    asked = found.where((F.col("n") > 0) & (F.col("first") + F.col("n") > low))
    if count is not None:
        asked = asked.where(F.col("first") < low + count)
    batches = sorted(r["batch"] for r in asked.select("batch").collect())
    columns = found.agg(F.min("columns")).first()[0]
    if columns is None:
        raise AnalyticsError("NOTHING_SAVED", "no rows are saved there", {"directory": directory})
    rows = _rows(spark, directory, batches, StructType.fromJson(json.loads(columns)))
    if first is not None:
        rows = rows.where((F.col(name) >= first) & (F.col(_BLOCK) >= _block(F.lit(first))))
    if count is not None:
        rows = rows.where((F.col(name) < low + count) & (F.col(_BLOCK) <= _block(F.lit(low + count - 1))))
    return rows.drop(_BLOCK, "batch")
