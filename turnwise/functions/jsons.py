"""Strict JSON handling on top of Spark's VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)

_CONTAINER_SHAPE = r"^(ARRAY|OBJECT)<"
_JSON_SPACE = " \t\r\n"


def parse_strict(text: Column) -> Column:
    """VARIANT of ``text`` if the whole text is one JSON value, else NULL.

    ``try_parse_json`` ignores anything after the first value. The text is therefore parsed as
    the first of two array items, the second being a hash of the text: only when the text is
    exactly one value do two items come back with the hash in second place.
    """
    mark = F.xxhash64(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = (F.try_variant_get(pair, "$[1]", "bigint") == mark) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.variant_get(pair, "$[0]", "variant"))


def nullify(value: Column) -> Column:
    """A JSON null is the same as a missing value."""
    return F.when(~F.is_variant_null(value), value)


def _opens_with(text: Column, bracket: str) -> Column:
    return F.ltrim(text, F.lit(_JSON_SPACE)).startswith(bracket)


def container_text(text: Column) -> Column:
    """VARIANT of ``text`` when it is a JSON object or array, else NULL.

    Only text that opens with a bracket is parsed; if that is JSON, it is a container.
    """
    return F.when(_opens_with(text, "{") | _opens_with(text, "["), parse_strict(text))


def is_container_text(text: Column) -> Column:
    """True when ``text`` is a JSON object or array; never NULL."""
    return container_text(text).isNotNull()


def decode_or_keep(text: Column) -> Column:
    """Parse any JSON value, scalars included; keep text that is not JSON as a string."""
    return nullify(F.coalesce(parse_strict(text), text.cast("variant")))


def to_variant(column: Column, data_type: T.DataType) -> Column:
    """Any column as VARIANT; strings are decoded, nested types become objects."""
    if isinstance(data_type, T.VariantType):
        return nullify(column)
    if isinstance(data_type, TEXT_TYPES):
        return decode_or_keep(column)
    if isinstance(data_type, T.BinaryType):
        text = F.when(F.is_valid_utf8(column.cast("string")), column.cast("string"))
        return F.coalesce(decode_or_keep(text), F.when(text.isNull(), F.base64(column)).cast("variant"))
    if isinstance(data_type, T.MapType) and not isinstance(data_type.keyType, T.StringType):
        column = F.map_from_entries(
            F.transform(
                F.map_entries(column),
                lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")),
            )
        )
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(column.isNotNull(), F.to_variant_object(column))
    return column.cast("variant")


def canonical_text(value: Column) -> Column:
    """JSON text of a VARIANT with object keys sorted at every level."""
    return F.to_json(value)


def utf8_or_base64(data: Column) -> Column:
    """Bytes as text when they are valid UTF-8, base64 otherwise."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.base64(data))


def value_kind(column: Column, data_type: T.DataType) -> Column:
    """Kind of each single value, NULL counting as ``unknown``."""
    if isinstance(data_type, TEXT_TYPES):
        kind = F.when(is_container_text(column), "json").otherwise("text")
    elif isinstance(data_type, T.VariantType):
        shape = F.schema_of_variant(column)
        text = F.try_variant_get(column, "$", "string")
        kind = (
            F.when(shape.rlike(_CONTAINER_SHAPE), "json")
            .when(shape == "BOOLEAN", "boolean")
            .when(shape.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
            .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
            .when(shape.rlike("^(DATE|TIMESTAMP)"), "timestamp")
            .when(shape == "BINARY", "binary")
            .when(shape == "STRING", F.when(is_container_text(text), "json").otherwise("text"))
            .otherwise("unknown")
        )
    elif isinstance(data_type, T.BooleanType):
        kind = F.lit("boolean")
    elif isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        kind = F.lit("integer")
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        kind = F.lit("float")
    elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        kind = F.lit("timestamp")
    elif isinstance(data_type, T.BinaryType):
        kind = F.lit("binary")
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        kind = F.lit("json")
    else:
        kind = F.lit("unknown")
    return F.when(column.isNull(), "unknown").otherwise(kind)


def container_summary(text: Column) -> Column:
    """``n keys`` / ``n items`` of a JSON container, '' when it is empty, NULL when it is none."""

    def counted(size: Column, unit: str) -> Column:
        return F.when(size == 0, "").when(
            size > 0, F.concat(size.cast("string"), F.lit(f" {unit}"))
        )

    value = parse_strict(text)
    return F.when(
        _opens_with(text, "{"), counted(F.size(F.json_object_keys(F.to_json(value))), "keys")
    ).when(_opens_with(text, "["), counted(F.size(value.cast("array<variant>")), "items"))
