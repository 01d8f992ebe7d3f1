"""From a SQL result to trajectories and their warnings in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnwise.operators.identity import (
    collision_warning,
    identity_name,
    identity_report,
    with_row_identity,
)
from turnwise.operators.shape import shape_result
from turnwise.operators.trajectory import (
    SEGMENT_ROWS,
    TrajectoryConfig,
    check_columns,
    messages,
    nest,
    summarise,
    trajectory_warnings,
)


@dataclass(frozen=True)
class TrajectoryResult:
    """Messages (long form), trajectories (nested form, in segments), summaries (a row per
    trajectory) and warnings. The tables are lazy, but building them runs up to three small jobs:
    two to find JSON columns unless they are named, one for the sizes of the groups."""

    messages: DataFrame
    trajectories: DataFrame
    summaries: DataFrame
    warnings: DataFrame


def build_trajectories(
    result: DataFrame,
    cfg: TrajectoryConfig,
    seq: str | Sequence[str],
    identity_column: str | None = None,
    segment_rows: int = SEGMENT_ROWS,
    max_group_rows: int | None = None,
    json_columns: Sequence[str] | None = None,
    max_bytes: int | None = None,
    segment_bytes: int | None = None,
) -> TrajectoryResult:
    """Shape a result, give every row an identity, and assemble trajectories.

    Warnings come from the identity report, the name collision check and the aggregation.
    """
    shaped = shape_result(result, json_columns)
    check_columns(shaped, cfg)
    name = identity_name(shaped.columns)
    rows = with_row_identity(shaped, identity_column, name)
    long_form = messages(rows, cfg, seq, name, max_group_rows, max_bytes, segment_bytes)
    warnings = (
        identity_report(rows, identity_column, name)
        .unionByName(collision_warning(shaped, name))
        .unionByName(trajectory_warnings(rows, cfg))
    )
    return TrajectoryResult(
        long_form, nest(long_form, segment_rows), summarise(long_form, seq), warnings
    )
