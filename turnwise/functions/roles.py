"""Role names of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import strip_role, strip_view

UNKNOWN_ROLE = "unknown"
# Roles with a kind of their own.
NAMED_KINDS = ("system", "user", "assistant", "tool")


def role_missing(role: Column) -> Column:
    """True for NULL and blank roles; never NULL."""
    return F.coalesce(strip_role(role.cast("string")), F.lit("")) == ""


def normalise_role(role: Column) -> Column:
    """Stripped role with its case kept, ``unknown`` when missing."""
    return F.when(role_missing(role), UNKNOWN_ROLE).otherwise(strip_role(role.cast("string")))


def role_key(role: Column) -> Column:
    """Roles that differ only in case or outer blanks share one key."""
    key = F.lower(strip_view(role))
    return F.when(key == "", UNKNOWN_ROLE).otherwise(key)


def role_kind(role: Column) -> Column:
    """system, user, assistant, tool, unknown or other."""
    key = role_key(F.coalesce(role, F.lit("")))
    return F.when(key.isin(*NAMED_KINDS, UNKNOWN_ROLE), key).otherwise("other")
