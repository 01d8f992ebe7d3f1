"""Result shaping: names, column catalog, JSON promotion, normalised values, previews."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.errors import AnalyticsError
from turnwise.functions.jsons import TEXT_TYPES, is_container_text, to_variant, utf8_or_base64, value_kind
from turnwise.functions.times import iso_text
from turnwise.operators.positions import SortKey, with_positions

# Bounds of a capped preview.
DEFAULT_ROW_LIMIT = 10_000
MAX_ROW_LIMIT = 100_000

# Rows looked at before a column is read whole.
PROBE_ROWS = 100

# Kinds a value can have.
VALUE_KINDS = ("text", "integer", "float", "boolean", "json", "timestamp", "binary", "unknown")


def unique_column_names(names: Sequence[str], case_sensitive: bool = True) -> list[str]:
    """Each name, or the first of ``name__2``, ``name__3`` ... that no earlier output has."""
    fold = str if case_sensitive else str.lower
    used: set[str] = set()

    def first_free(name: str) -> str:
        numbered = (f"{name}__{number}" for number in count(2))
        chosen = next(option for option in chain([name], numbered) if fold(option) not in used)
        used.add(fold(chosen))
        return chosen

    return [first_free(name) for name in names]


def unique_names(df: DataFrame) -> DataFrame:
    """Unique output names; names that differ only in case count as equal where Spark says so."""
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    return df.toDF(*unique_column_names(df.columns, case_sensitive))


def inferred_type(data_type: T.DataType) -> str:
    """The inferred type of a column from its Spark type alone."""
    if isinstance(data_type, TEXT_TYPES):
        return "text"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.VariantType, T.ArrayType, T.MapType, T.StructType)):
        return "json"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.BinaryType):
        return "binary"
    return "unknown"


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT_TYPES)]


def _holds_json(name: str) -> Column:
    return F.coalesce(F.bool_or(is_container_text(F.col(f"`{name}`"))), F.lit(False))


def column_catalog(
    df: DataFrame, table: str, json_columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per column: table, position, name, source type, inferred type.

    A text column that holds any JSON object or array counts as ``json``. All columns are decided by one aggregate over one scan, which is
    left out where the types are not asked for; where ``json_columns`` is given, nothing is read.
    """
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(number).alias("ordinal"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("sql_type"),
            F.lit(inferred_type(field.dataType)).alias("inferred_type"),
        )
        for number, field in enumerate(df.schema.fields, 1)
    ]
    catalog = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    texts = _string_columns(df)
    if json_columns is not None:
        texts = [name for name in texts if name in json_columns]
        holding = F.array(*map(F.lit, texts)) if texts else None
    else:
        flags = [F.when(_holds_json(name), F.lit(name)) for name in texts]
        holding = df.agg(F.array_compact(F.array(*flags)).alias("names")).scalar() if texts else None
    if holding is None:
        return catalog
    kind = F.when(F.array_contains(holding, F.col("column_name")), "json").otherwise(F.col("inferred_type"))
    return catalog.withColumn("inferred_type", kind)


def json_promotion(df: DataFrame, table: str) -> DataFrame:
    """One row per text column: whether any value is a JSON object or array."""
    names = _string_columns(df)
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(name).alias("column_name"),
            _holds_json(name).alias("is_json"),
        )
        for name in names
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def promoted_columns(df: DataFrame) -> list[str]:
    """Names of the text columns that hold JSON, which changes their type.

    A few rows usually show which columns do. Only the columns without JSON there are read
    whole, by one aggregate that brings back one row: they hold none until the last row says so.
    """
    names = _string_columns(df)
    first = df.select(*[is_container_text(F.col(f"`{n}`")).alias(n) for n in names])
    shown = first.take(PROBE_ROWS) if names else []
    found = {n for i, n in enumerate(names) if any(row[i] for row in shown)}
    rest = [n for n in names if n not in found]
    if rest:
        flags = df.agg(*[_holds_json(n).alias(f"c{i}") for i, n in enumerate(rest)]).head()
        found.update(n for i, n in enumerate(rest) if flags[i])
    return [n for n in names if n in found]


def value_kind_profile(df: DataFrame) -> DataFrame:
    """Values per column and kind. One aggregate: no row is copied once per column."""
    kinds = df.select(
        *[
            value_kind(F.col(f"`{f.name}`"), f.dataType).alias(f"k{i}")
            for i, f in enumerate(df.schema.fields)
        ]
    )
    counts = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(kind).alias("kind"),
            F.count_if(F.col(f"k{i}") == kind).alias("n_values"),
        )
        for i, field in enumerate(df.schema.fields)
        for kind in VALUE_KINDS
        if kind in _possible_kinds(field.dataType)
    ]
    return kinds.agg(F.array(*counts).alias("rows")).select(F.inline("rows")).where("n_values > 0")


def _possible_kinds(data_type: T.DataType) -> set[str]:
    if isinstance(data_type, T.VariantType):
        return set(VALUE_KINDS)
    if isinstance(data_type, TEXT_TYPES):
        return {"text", "json", "unknown"}
    if isinstance(data_type, T.DecimalType):
        return {"unknown"}
    return {inferred_type(data_type), "unknown"}


def normalise_value(column: Column, data_type: T.DataType, kind: str) -> Column:
    """One column in its normalised form for the inferred type ``kind``."""
    if kind == "json":
        return to_variant(column, data_type)
    if kind == "timestamp":
        return iso_text(column, data_type)
    if kind == "binary":
        return F.base64(column)
    if kind == "text" and isinstance(data_type, T.BinaryType):
        return utf8_or_base64(column)
    if kind == "float" and isinstance(data_type, T.DecimalType):
        return column.cast("double")
    if kind == "integer":
        return column.cast("bigint")
    if kind == "unknown":
        return column.cast("string")
    return column


def normalise(
    df: DataFrame, json_columns: Sequence[str] = (), text_columns: Sequence[str] = ()
) -> DataFrame:
    """All columns normalised; ``json_columns`` are the promoted text columns, ``text_columns`` hold
    the bytes of texts."""

    def kind(field: T.StructField) -> str:
        if field.name in json_columns:
            return "json"
        return "text" if field.name in text_columns else inferred_type(field.dataType)

    return df.select(
        *[
            normalise_value(F.col(f"`{f.name}`"), f.dataType, kind(f)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def shape_result(df: DataFrame, json_columns: Sequence[str] | None = None) -> DataFrame:
    """Unique names, JSON promotion and normalised values in one go.

    Promotion reads every text column once. Where it is known which columns hold JSON, naming
    them in ``json_columns`` saves that scan.
    """
    named = unique_names(df)
    return normalise(named, promoted_columns(named) if json_columns is None else json_columns)


def check_row_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_ROW_LIMIT:
        raise AnalyticsError(
            "ROW_LIMIT_OUT_OF_RANGE", f"row limit must be 1 to {MAX_ROW_LIMIT}", {"limit": limit}
        )
    return limit


def preview(
    df: DataFrame, order: Sequence[Column | str], limit: int = DEFAULT_ROW_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows of a total order, and a warning when rows were left out.

    The limit is the point of this operator and is bounded, so Spark keeps ``limit`` rows per
    task and merges them; there is no full sort. The warning counts no further than one row beyond.
    """
    check_row_limit(limit)
    rows = df.orderBy(*order).limit(limit)
    warnings = df.limit(limit + 1).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(
        F.lit("RESULT_TRUNCATED").alias("code"),
        F.lit(None).cast("string").alias("group_key"),
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("bigint").alias("count"),
    )
    return rows, warnings


def hide_columns(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Drop hidden columns; the scan does not read them."""
    return df.drop(*hidden)


def number_rows(
    df: DataFrame, order: Sequence[SortKey], name: str = "row_no", max_rows: int | None = None
) -> DataFrame:
    """Number the whole table in a total order without sorting it in one task."""
    return with_positions(df, [], order, position=name, max_rows=max_rows)


def result_summary(df: DataFrame, table: str) -> DataFrame:
    """Rows and columns of a result."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(table).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )

