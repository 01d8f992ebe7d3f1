"""Common ways to get from stored tables to one row per message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.jsons import parse_strict


def message_rows(
    df: DataFrame, columns: dict[str, str], since: Column | None, order: Sequence[str]
) -> DataFrame:
    """Project and rename columns to message fields, filter by time, sort."""
    picked = df if since is None else df.where(since)
    return picked.select(*[F.col(old).alias(new) for new, old in columns.items()]).orderBy(*order)


def json_text(column: Column, path: str) -> Column:
    """Text of one JSON field, without quotes."""
    return F.get_json_object(column, path)


def json_value(column: Column, path: str) -> Column:
    """One JSON field as a VARIANT."""
    return F.try_variant_get(parse_strict(column), path, "variant")


def failed_cases(
    messages: DataFrame, evaluations: DataFrame, on: str, failed: Column, order: Sequence[str]
) -> DataFrame:
    """Messages joined to their failed evaluations, sorted.

    The join strategy is left to adaptive execution: it broadcasts the failed evaluations only
    when their measured size is small and splits skewed join partitions otherwise.
    """
    return messages.join(evaluations.where(failed), on, "inner").orderBy(*order)
