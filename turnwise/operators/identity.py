"""Row identity: a key column or a hash of the whole row, and a report on its quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.jsons import canonical_text, to_variant
from turnwise.functions.times import iso_text

IDENTITY = "_row_identity"
FALLBACK_IDENTITY = "_row_identity_alt"

WARNING_SCHEMA = "code string, group_key string, column string, count bigint"


def identity_name(columns: Iterable[str]) -> str:
    """The reserved name, or the first free fallback when the input already uses it."""
    used = set(columns)
    if IDENTITY not in used:
        return IDENTITY
    name, number = FALLBACK_IDENTITY, 1
    while name in used:
        number += 1
        name = f"{FALLBACK_IDENTITY}_{number}"
    return name


def _value_text(field: T.StructField) -> tuple[str, Column]:
    """Type tag and text of one column."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        return "b", column.cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i", column.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "f", column.cast("double").cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "s", iso_text(column, kind)
    if isinstance(kind, T.BinaryType):
        return "s", F.base64(column)
    if isinstance(kind, (T.VariantType, T.ArrayType, T.MapType, T.StructType)):
        return "j", canonical_text(to_variant(column, kind))
    return "s", column.cast("string")


def row_hash(df: DataFrame, name: str, needed: Column | None = None) -> DataFrame:
    """Add the SHA-1 over all columns in name order, for the rows that need one.

    Each column is written as ``name=tag:length:value``; NULL has a tag of its own and no value.
    Object keys inside values are sorted. The texts are columns of their own first, so that a
    costly one, such as JSON, is made once.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    texts = {f"__tw_text{i}": _value_text(f) for i, f in enumerate(fields)}
    staged = df.withColumns(
        {
            helper: value if needed is None else F.when(needed, value)
            for helper, (_, value) in texts.items()
        }
    )
    parts = []
    for field, (helper, (tag, _)) in zip(fields, texts.items(), strict=True):
        size = F.length(helper).cast("string")
        written = F.concat(F.lit(f"{field.name}={tag}:"), size, F.lit(":"), F.col(helper))
        parts.append(F.coalesce(written, F.lit(f"{field.name}=n")))
    return staged.withColumn(name, F.sha1(F.concat_ws("|", *parts))).drop(*texts)


def with_row_identity(df: DataFrame, key: str | None = None, name: str | None = None) -> DataFrame:
    """Add the identity column: the key's text where it is set, else the row hash."""
    name = name or identity_name(df.columns)
    if key is None or key not in df.columns:
        return row_hash(df, name)
    given = F.col(f"`{key}`").cast("string")
    hashed = row_hash(df, name, given.isNull())
    return hashed.withColumn(name, F.coalesce(given, F.col(name)))


def identity_report(df: DataFrame, key: str | None, identity: str = IDENTITY) -> DataFrame:
    """Warnings about identities as rows of code, group_key, column and count.

    ``df`` carries the identity column. One scan and one shuffle answer all questions; counts are
    pre-aggregated per identity, so one that many rows share costs no more than any other.
    """
    missing = key is not None and key not in df.columns
    no_key = F.lit(False) if key is None or missing else F.col(f"`{key}`").isNull()
    per_identity = df.groupBy(F.col(f"`{identity}`").alias("__tw_identity")).agg(
        F.count("*").alias("n"), F.count_if(no_key).alias("nulls")
    )
    totals = per_identity.agg(
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.count_if(F.col("n") > 1).alias("copies"),
    )

    def warning(code: str, when: Column, count: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(None).cast("string").alias("group_key"),
                F.lit(key).cast("string").alias("column"),
                count.cast("bigint").alias("count"),
            ),
        )

    nulls, copies = F.col("nulls"), F.col("copies")
    found = F.array(
        warning("ROW_IDENTITY_COLUMN_MISSING", F.lit(missing), F.lit(None)),
        warning("ROW_IDENTITY_COLUMN_NULL", nulls > 0, nulls),
        warning("ROW_IDENTITY_DUPLICATE", copies > 0, copies),
    )
    return totals.select(F.inline(F.array_compact(found)))


def collision_warning(df: DataFrame, name: str) -> DataFrame:
    """One warning when the reserved identity name was taken by the input, else no rows."""
    return df.sparkSession.range(1).where(F.lit(name != IDENTITY)).select(
        F.lit("ROW_IDENTITY_KEY_COLLISION").alias("code"),
        F.lit(None).cast("string").alias("group_key"),
        F.lit(name).alias("column"),
        F.lit(None).cast("bigint").alias("count"),
    )

