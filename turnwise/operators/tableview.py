"""Table-view sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import natural_key
from turnwise.operators.positions import SortKey, with_positions

_KEY = "__tw_natural"


def _keyed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(_KEY, natural_key(F.col(f"`{column}`"), df.schema[column].dataType))


def _order(ascending: bool, seq: str) -> list[SortKey]:
    # NULLs come first when ascending and last when descending; ties keep the input order.
    return [SortKey(_KEY, ascending, nulls_first=ascending), SortKey(seq)]


def natural_sort(
    df: DataFrame, sort: Sequence[tuple[str, str]], seq: str
) -> DataFrame:
    """Sort by the first (column, direction) only; later ones are ignored. Range-partitioned."""
    if not sort:
        return df.orderBy(seq)
    column, direction = sort[0]
    keys = [k.expression() for k in _order(direction == "asc", seq)]
    return _keyed(df, column).orderBy(*keys).drop(_KEY)


def natural_positions(
    df: DataFrame,
    sort: Sequence[tuple[str, str]],
    seq: str,
    name: str = "row_no",
    max_rows: int | None = None,
) -> DataFrame:
    """Row numbers in the order of :func:`natural_sort`."""
    if not sort:
        return with_positions(df, [], [SortKey(seq)], position=name, max_rows=max_rows)
    column, direction = sort[0]
    order = _order(direction == "asc", seq)
    return with_positions(_keyed(df, column), [], order, position=name, max_rows=max_rows).drop(_KEY)
