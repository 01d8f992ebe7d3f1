"""Timestamp reading and printing in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.jsons import TEXT_TYPES
from turnwise.functions.text import strip_view

# Format tokens and the Spark pattern that prints each of them.
FORMAT_TOKENS = {
    "YYYY": "yyyy",
    "yyyy": "yyyy",
    "YY": "yy",
    "yy": "yy",
    "MM": "MM",
    "DD": "dd",
    "dd": "dd",
    "HH": "HH",
    "mm": "mm",
    "ss": "ss",
    "SSS": "SSS",
}
# Fixed value: the largest distance from the epoch, in milliseconds, that is a time.
MAX_MILLIS = 8_640_000_000_000_000
DEFAULT_FORMAT = "YYYY-MM-DD HH:mm:ss"

# Text that Spark reads as it stands, in UTC when it names no zone.
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})?)?$"
# Date, time, fraction and zone of other ISO-8601 text, in extended or basic form.
_DATE = r"^(\d{4}(?:-\d{2}(?:-\d{2})?|\d{2}(?:\d{2})?)?)"
_TIME = r"(?:[Tt](\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?)(?:[.,](\d+))?)?"
_ZONE = r"([Zz]|[+-]\d{2}(?::?\d{2})?)?$"
_ISO = _DATE + _TIME + _ZONE


def _rewritten(text: Column) -> Column:
    """Any ISO-8601 form as ``yyyy-MM-ddTHH:mm:ss.ffffff+hhmm``, NULL when it is none."""
    joined = F.regexp_replace(strip_view(text), r"^(\S+)\s+", "$1T")

    def rewrite(iso: Column) -> Column:
        def digits(group: int, full: str) -> Column:
            found = F.regexp_replace(F.regexp_extract(iso, _ISO, group), "[-:]", "")
            return F.concat(found, F.substring(F.lit(full), F.length(found) + 1, F.lit(len(full))))

        day = F.regexp_replace(digits(1, "00000101"), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3T")
        time = F.regexp_replace(digits(2, "000000"), r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3.")
        fraction = F.substring(F.concat(F.regexp_extract(iso, _ISO, 3), F.lit("0")), 1, 6)
        zone = F.rpad(F.regexp_replace(F.regexp_extract(iso, _ISO, 4), ":", ""), 5, "0")
        offset = F.when(zone.rlike("^[+-]"), zone).otherwise("+0000")
        return F.when(iso.rlike(_ISO), F.concat(day, time, fraction, offset))

    # As the item of an array, the cleaned text is made once for all its uses.
    return F.get(F.transform(F.array(joined), rewrite), F.lit(0))


def parse_iso(text: Column) -> Column:
    """TIMESTAMP of ISO text: no zone means UTC, a bare date is midnight, NULL when unreadable."""
    return F.try_to_timestamp(F.when(text.rlike(_PLAIN), text).otherwise(_rewritten(text)))


def to_utc(column: Column, data_type: T.DataType) -> Column:
    """TIMESTAMP of a text, a number of epoch milliseconds, a date or a timestamp."""
    if isinstance(data_type, TEXT_TYPES):
        return parse_iso(column)
    if isinstance(data_type, T.NumericType):
        return F.when(F.abs(column) <= MAX_MILLIS, F.timestamp_millis(column.try_cast("bigint")))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp")
    return F.lit(None).cast("timestamp")


def print_utc(moment: Column, pattern: str = DEFAULT_FORMAT) -> Column:
    """Print with the format tokens; every other character is copied."""
    pieces = re.split("(" + "|".join(FORMAT_TOKENS) + ")", pattern)
    quoted = [FORMAT_TOKENS.get(p) or "'" + p.replace("'", "''") + "'" for p in pieces if p]
    return F.date_format(moment, "".join(quoted))


def format_timestamp(
    column: Column, data_type: T.DataType, pattern: str = DEFAULT_FORMAT
) -> Column:
    """Formatted timestamp, or the value's own text when it cannot be read as one."""
    return F.coalesce(print_utc(to_utc(column, data_type), pattern), column.cast("string"))


def iso_text(column: Column, data_type: T.DataType) -> Column:
    """ISO text; microseconds are printed only when they are not zero."""
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    full = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(full.endswith(".000000"), F.regexp_replace(full, r"\.000000$", "")).otherwise(full)
