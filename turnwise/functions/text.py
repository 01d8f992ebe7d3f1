"""Text functions: stripping, natural sort keys, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.jsons import canonical_text, to_variant

# The characters stripped from role text (Unicode white space plus the four
# separator controls) and from text shown in the viewer (white space plus the byte-order mark).
ROLE_SPACE = r"[\s\x1c-\x1f]"
VIEW_SPACE = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Preview lengths.
LINE_PREVIEW = 80
BLOCK_PREVIEW = 800
RECENT_SQL_PREVIEW = 100
LISTED_SQL_PREVIEW = 60


def strip_role(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{ROLE_SPACE}+|{ROLE_SPACE}+\z", "")


def strip_view(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{VIEW_SPACE}+|{VIEW_SPACE}+\z", "")


def cut(text: Column, length: int) -> Column:
    """First ``length`` characters, with ``...`` when something was cut off."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def first_line_preview(text: Column, length: int = LINE_PREVIEW) -> Column:
    """First line only, cut to ``length``."""
    return cut(F.get(F.split(text, r"\r?\n", 2), F.lit(0)), length)


def block_preview(text: Column, length: int = BLOCK_PREVIEW) -> Column:
    """All lines, cut to ``length``."""
    return cut(text, length)


def one_line(text: Column, length: int) -> Column:
    """White-space runs become one blank, then cut to ``length``."""
    return cut(strip_view(F.regexp_replace(text, f"{VIEW_SPACE}+", " ")), length)


def cell_text(column: Column, data_type: T.DataType) -> Column:
    """Text of one cell: ``NULL`` for missing values, compact JSON for nested ones."""
    if isinstance(data_type, T.VariantType):
        shown = F.coalesce(
            F.when(
                F.schema_of_variant(column).rlike(r"^(ARRAY|OBJECT)<"), canonical_text(column)
            ),
            F.try_variant_get(column, "$", "string"),
        )
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        shown = canonical_text(to_variant(column, data_type))
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        exact = isinstance(data_type, T.DoubleType)
        shown = number_text(column if exact else column.cast("string").cast("double"))
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def number_text(number: Column) -> Column:
    """A double as a browser prints it: plain digits from 1e-6 up to 1e21, else with an exponent."""
    size = F.abs(number)
    fixed = F.when(size >= 1, number.try_cast("decimal(38,16)").cast("string")).otherwise(
        number.try_cast("decimal(38,24)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), "E(?=[0-9])", "e+")
    return (
        F.when(number == 0, "0")
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(F.regexp_replace(shown, "E-", "e-"))
    )


def natural_key(column: Column, data_type: T.DataType) -> Column:
    """Sort key: numbers, booleans and times as they are, text by value of its digit runs.

    Each digit run is written as its ten-digit length followed by the digits without leading
    zeros, so runs of any length compare by value. The key ignores case and accents.
    """
    native = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(data_type, native):
        return column
    text = F.when(column.isNotNull(), cell_text(column, data_type))
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(
            run.rlike("^[0-9]"),
            F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits),
        ).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, encode), ""), "UNICODE_CI_AI")
