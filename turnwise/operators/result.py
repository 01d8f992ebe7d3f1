"""From a SQL result to a row table: normalised rows, described columns and warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnwise.operators.classify import Rule, classify_columns
from turnwise.operators.identity import (
    collision_warning,
    identity_name,
    identity_report,
    with_row_identity,
)
from turnwise.operators.shape import column_catalog, promoted_columns, shape_result, unique_names


@dataclass(frozen=True)
class RowTable:
    """Rows with identity, one row per column with its class, warnings. The tables are lazy, but
    building them runs up to two jobs to find JSON columns unless they are named, and one that counts
    the regular expressions of the rules."""

    rows: DataFrame
    columns: DataFrame
    warnings: DataFrame
    identity: str


def build_row_table(
    result: DataFrame,
    name: str,
    identity_column: str | None = None,
    rules: DataFrame | Sequence[Rule] = (),
    json_columns: Sequence[str] | None = None,
) -> RowTable:
    """Shape a whole result, give every row an identity and classify the columns."""
    named = unique_names(result)
    json_columns = promoted_columns(named) if json_columns is None else list(json_columns)
    shaped = shape_result(named, json_columns)
    identity = identity_name(shaped.columns)
    rows = with_row_identity(shaped, identity_column, identity)
    warnings = identity_report(rows, identity_column, identity).unionByName(
        collision_warning(shaped, identity)
    )
    columns = classify_columns(column_catalog(named, name, json_columns), rules)
    return RowTable(rows, columns, warnings, identity)
