"""Operators over the long form of trajectories: role lists, role filters, metadata lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.jsons import TEXT_TYPES
from turnwise.functions.roles import role_key
from turnwise.functions.text import cell_text
from turnwise.functions.times import parse_iso, print_utc

# Metadata fields shown first, the suffix of timestamp fields, the separator.
META_FIELDS = ("created_at", "latency", "latency_ms", "duration_ms")
TIME_FIELD_SUFFIX = "_at"
META_SEPARATOR = " · "

_KEYS = ["group_value", "group_key", "group_is_null"]


def role_list(messages: DataFrame) -> DataFrame:
    """Distinct roles per trajectory, compared without case and outer blanks.

    The first spelling is kept; ``first_position`` gives the order in which roles appear. Roles
    are pre-aggregated before the shuffle.
    """
    return (
        messages.groupBy(*_KEYS, role_key(F.col("role")).alias("role_key"))
        .agg(F.min_by("role", "position").alias("role"), F.min("position").alias("first_position"))
        .drop("group_value")
    )


def _wanted(roles: Sequence[str]) -> Column:
    return F.lower("role").isin(*[r.lower() for r in roles])


def filter_roles(messages: DataFrame, roles: Sequence[str] | None) -> DataFrame:
    """Messages whose role is listed, ignoring case; None keeps all."""
    return messages if roles is None else messages.where(_wanted(roles))


def role_filter_counts(messages: DataFrame, roles: Sequence[str] | None) -> DataFrame:
    """Visible and total messages per trajectory for a role filter."""
    visible = F.lit(True) if roles is None else _wanted(roles)
    return (
        messages.groupBy(*_KEYS)
        .agg(F.count_if(visible).alias("visible"), F.count("*").alias("total"))
        .drop("group_value")
    )


def meta_fields(columns: Sequence[str]) -> list[str]:
    """Fields of the metadata line that exist, in display order."""
    extra = [c for c in columns if c.lower().endswith(TIME_FIELD_SUFFIX) and c not in META_FIELDS]
    return [c for c in [*META_FIELDS, *extra] if c in columns]


def meta_line(df: DataFrame, prefix: str = "") -> Column:
    """``field: value`` of every filled metadata field, joined by a middle dot.

    ``prefix`` is a struct column, such as ``raw``, that holds the fields.
    """
    schema = df.schema[prefix].dataType if prefix else df.schema
    parts = []
    for name in meta_fields([f.name for f in schema.fields]):
        kind = schema[name].dataType
        value = F.col(f"`{prefix}`.`{name}`" if prefix else f"`{name}`")
        text = F.when(value.isNotNull(), cell_text(value, kind))
        if isinstance(kind, TEXT_TYPES) and name.lower().endswith(TIME_FIELD_SUFFIX):
            text = F.coalesce(print_utc(parse_iso(value)), text)
        parts.append(F.when(text != "", F.concat(F.lit(f"{name}: "), text)))
    return F.concat_ws(META_SEPARATOR, *parts)
