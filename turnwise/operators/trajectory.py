"""Trajectories: rows of one session, ordered, each row a message.

The long form (one row per message) is the form to use at scale. The nested form is built from
it in segments of bounded length, so that a session of any size never ends up in one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.errors import AnalyticsError
from turnwise.functions.jsons import TEXT_TYPES, canonical_text, decode_or_keep, nullify
from turnwise.functions.roles import normalise_role, role_missing
from turnwise.operators.identity import IDENTITY
from turnwise.operators.positions import SortKey, max_group_bytes, orderable, row_bytes, with_positions

NULL_GROUP = "__null__"
SEGMENT_ROWS = 1000

# Helper columns; the input may use any plain name itself.
_GROUP = "__tw_group"
_POSITION = "__tw_position"
_TOTAL = "__tw_total"
_BEFORE = "__tw_before"
_BAD = "__tw_bad"
_NULL_RANK = "__tw_order_null"
_ORDER = "__tw_order_"


@dataclass(frozen=True)
class TrajectoryConfig:
    """Which columns make a trajectory."""

    group_by: str
    role_column: str
    content_column: str
    tool_calls_column: str | None = None
    order_by: str | None = None
    order_direction: str = "asc"

    def __post_init__(self) -> None:
        for field in ("group_by", "role_column", "content_column"):
            if not getattr(self, field):
                raise AnalyticsError(
                    "TRAJECTORY_CONFIG_INVALID", f"{field} must not be empty", {"field": field}
                )
        if self.order_direction not in ("asc", "desc"):
            raise AnalyticsError(
                "TRAJECTORY_CONFIG_INVALID",
                "order_direction must be asc or desc",
                {"order_direction": self.order_direction},
            )


def check_columns(df: DataFrame, cfg: TrajectoryConfig) -> None:
    """Role and content are checked first, then the group column; no job is run."""
    for column in (cfg.role_column, cfg.content_column):
        if column not in df.columns:
            raise AnalyticsError(
                "TRAJECTORY_REQUIRED_COLUMN_MISSING", f"column '{column}' is missing", {"column": column}
            )
    if cfg.group_by not in df.columns:
        raise AnalyticsError(
            "TRAJECTORY_GROUP_BY_MISSING",
            f"column '{cfg.group_by}' is missing",
            {"group_by": cfg.group_by},
        )


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _group_value(df: DataFrame, cfg: TrajectoryConfig) -> Column:
    """The grouping value in its own type; JSON groups by canonical text, so 1 and "1" differ."""
    column, kind = F.col(f"`{cfg.group_by}`"), df.schema[cfg.group_by].dataType
    if isinstance(kind, T.VariantType):
        return canonical_text(nullify(column))
    if not orderable(kind):
        return canonical_text(F.to_variant_object(column))
    return column


def _group_label(df: DataFrame, cfg: TrajectoryConfig) -> Column:
    """Printed group key; the NULL group prints as ``__null__``."""
    value, kind = F.col(_GROUP), df.schema[cfg.group_by].dataType
    if isinstance(kind, T.VariantType):
        plain = F.try_variant_get(F.try_parse_json(value), "$", "string")
        return F.coalesce(plain, value, F.lit(NULL_GROUP))
    return F.coalesce(value.cast("string"), F.lit(NULL_GROUP))


def _unsortable_mark(df: DataFrame, cfg: TrajectoryConfig) -> Column | None:
    """Aggregate that is true for groups whose order values cannot be compared."""
    if cfg.order_by is None or cfg.order_by not in df.columns:
        return None
    column, kind = F.col(f"`{cfg.order_by}`"), df.schema[cfg.order_by].dataType
    if isinstance(kind, T.VariantType):
        value = nullify(column)
        text = canonical_text(value)
        family = _variant_family(value)
        differ = F.min(text) != F.max(text)
        comparable = F.lit(False)
        for name in ("number", "string", "numbers", "strings"):
            # An empty list goes with lists of either kind.
            fits = (name, "empty") if name.endswith("s") else (name,)
            comparable = comparable | (F.count_if(family.isNotNull() & ~family.isin(*fits)) == 0)
        return F.coalesce(differ & ~comparable, F.lit(False))
    if isinstance(kind, (T.MapType, T.StructType)):
        text = F.when(column.isNotNull(), canonical_text(F.to_variant_object(column)))
        return F.coalesce(F.min(text) != F.max(text), F.lit(False))
    return None


_NUMBER = r"(TINYINT|SMALLINT|INT|BIGINT|DECIMAL(\([0-9,]*\))?|DOUBLE|FLOAT|BOOLEAN)"


def _variant_family(value: Column) -> Column:
    """What a VARIANT can be compared with: numbers, strings, and lists of either."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.rlike(rf"^{_NUMBER}$"), "number")
        .when(shape == "STRING", "string")
        .when(shape.rlike(rf"^ARRAY<{_NUMBER}>$"), "numbers")
        .when(shape == "ARRAY<STRING>", "strings")
        .when((shape == "ARRAY<VOID>") & (canonical_text(value) == "[]"), "empty")
        .when(value.isNotNull(), "other")
    )


def _with_order(
    df: DataFrame, cfg: TrajectoryConfig, ties: Sequence[str]
) -> tuple[DataFrame, list[SortKey]]:
    """Add helper sort columns and return the total order inside a group.

    Ascending puts NULLs last, descending puts them first; ties keep the input order. Without
    an order column, or in groups that cannot be sorted, the input order is kept.
    """
    by_input = [SortKey(name) for name in ties if name != cfg.order_by]
    if cfg.order_by is None or cfg.order_by not in df.columns:
        return df, [SortKey(name) for name in ties]
    ascending = cfg.order_direction == "asc"
    column, kind = F.col(f"`{cfg.order_by}`"), df.schema[cfg.order_by].dataType
    mark = _unsortable_mark(df, cfg)
    if mark is None:
        return df, [SortKey(cfg.order_by, ascending, nulls_first=not ascending), *by_input]

    bad = df.groupBy(_GROUP).agg(mark.alias(_BAD)).where(_BAD)
    bad = bad.select(F.col(_GROUP).alias(_BAD + "_group"), _BAD)
    df = df.join(bad, F.col(_GROUP).eqNullSafe(F.col(_BAD + "_group")), "left")
    keep = F.col(_BAD).isNull()
    value = nullify(column) if isinstance(kind, T.VariantType) else column
    helpers = {_NULL_RANK: F.when(keep, value.isNull())}
    if isinstance(kind, T.VariantType):
        family = _variant_family(value)

        def read(kind: str, *families: str) -> Column:
            return F.when(keep & family.isin(*families), F.try_variant_get(value, "$", kind))

        # Doubles order all numbers; those that are one double, such as integers beyond 2^53, differ
        # in their decimals.
        helpers[_ORDER + "number"] = read("double", "number")
        helpers[_ORDER + "whole"] = read("decimal(38,0)", "number")
        helpers[_ORDER + "exact"] = read("decimal(38,18)", "number")
        helpers[_ORDER + "string"] = read("string", "string")
        helpers[_ORDER + "numbers"] = read("array<double>", "numbers", "empty")
        helpers[_ORDER + "strings"] = read("array<string>", "strings", "empty")
    df = df.withColumns(helpers).drop(_BAD, _BAD + "_group")
    keys = [SortKey(name, ascending, nulls_first=not ascending) for name in helpers]
    return df, [*keys, *by_input]


def _located(df: DataFrame, cfg: TrajectoryConfig) -> DataFrame:
    return df.withColumn(_GROUP, _group_value(df, cfg))


def messages(
    df: DataFrame,
    cfg: TrajectoryConfig,
    seq: str | Sequence[str],
    identity: str = IDENTITY,
    max_group_rows: int | None = None,
    max_bytes: int | None = None,
    segment_bytes: int | None = None,
) -> DataFrame:
    """Long form: one row per message.

    ``seq`` names the column(s) that give the input order and are unique within a group: Spark
    tables have no order of their own. Ties of the order column keep this order. Roles, tool
    calls and ``raw`` are derived after the shuffle, so each value is moved once.

    With ``max_bytes`` (or the setting ``turnwise.maxGroupBytes``) the parts into which large groups are cut are bounded in bytes too, which
    takes a scan of all columns. With ``segment_bytes`` a column ``byte_cell`` is added, by which ``nest`` closes segments.
    """
    check_columns(df, cfg)
    if identity not in df.columns:
        raise AnalyticsError(
            "TRAJECTORY_ROW_IDENTITY_MISSING", f"column '{identity}' is missing", {"column": identity}
        )
    raw = [c for c in df.columns if c != identity]
    grouped = _located(df, cfg)
    located, order = _with_order(grouped, cfg, _names(seq))
    size, cell = row_bytes(df, raw), []
    half = max(1, (segment_bytes or 0) // 2)
    # A message of more than half a segment gets half of one before and behind it, so it shares its cell with none.
    large = size > half
    placed = with_positions(
        located, [_GROUP], order, position=_POSITION, total=_TOTAL, max_rows=max_group_rows,
        max_bytes=max_group_bytes(df, max_bytes), weight=size + F.when(large, 2 * half).otherwise(0) if segment_bytes else size,
        running=_BEFORE if segment_bytes else None, sized=grouped,
    )
    if segment_bytes:
        start = F.col(_BEFORE) + F.when(large, half).otherwise(0)
        cell = [F.floor(start / F.lit(half)).cast("bigint").alias("byte_cell")]
    return placed.select(
        F.col(_GROUP).alias("group_value"),
        _group_label(df, cfg).alias("group_key"),
        F.col(_GROUP).isNull().alias("group_is_null"),
        F.col(_TOTAL).alias("message_count"),
        F.col(_POSITION).alias("position"),
        F.col(f"`{identity}`").cast("string").alias("row_identity"),
        normalise_role(_text(df, cfg.role_column)).alias("role"),
        F.col(f"`{cfg.content_column}`").alias("content"),
        decode_tool_calls(df, cfg.tool_calls_column).alias("tool_calls"),
        F.struct(*[F.col(f"`{c}`") for c in raw]).alias("raw"),
        *cell,
    )


def _text(df: DataFrame, column: str) -> Column:
    """A column as text; JSON strings come without quotes."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.VariantType):
        return F.coalesce(F.try_variant_get(c, "$", "string"), canonical_text(nullify(c)))
    return c.cast("string")


def decode_tool_calls(df: DataFrame, column: str | None) -> Column:
    """VARIANT of the tool-call column: text is decoded where it is JSON, else kept."""
    if column is None or column not in df.columns:
        return F.lit(None).cast("variant")
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, TEXT_TYPES):
        return decode_or_keep(c)
    if isinstance(kind, T.VariantType):
        text = F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
        return F.coalesce(decode_or_keep(text), nullify(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.to_variant_object(c))
    return c.cast("variant")


def nest(long_form: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Nested form: one row per trajectory segment with its messages in order.

    Trajectories of up to ``segment_rows`` messages are one row (segment 0); longer ones go on
    in segments 1, 2 ... The grouping reuses the partitioning of the long form.

    If the long form was made with ``segment_bytes``, the messages of a segment have no more bytes than that, but for a message that is larger
    and then alone. Numbers of segments rise, and may leave gaps.
    """
    segment = F.expr(f"(position - 1) div {int(segment_rows)}")
    if "byte_cell" in long_form.columns:
        # Neither number ever falls, so their sum rises exactly where one of them does.
        segment = segment + F.col("byte_cell")
    segment = segment.cast("bigint" if "byte_cell" in long_form.columns else "int")
    # Sorted by position alone; the other fields may be of types that have no order.
    by_position = F.array_sort(
        F.collect_list(F.struct("position", "row_identity", "role", "content", "tool_calls", "raw")),
        lambda a, b: (a["position"] - b["position"]).cast("int"),
    )
    return (
        long_form.withColumn("segment", segment)
        .groupBy("group_value", "group_key", "group_is_null", "message_count", "segment")
        .agg(by_position.alias("messages"))
        .drop("group_value")
    )


def summarise(long_form: DataFrame, seq: str | Sequence[str]) -> DataFrame:
    """One row per trajectory, however long: first and last role, size, and where it was first seen.

    Aggregates of the long form that combine before any further shuffle. ``first_seq`` (a struct for
    several columns) is the input place of the trajectory's first row, whose order is the order of
    the trajectories.
    """
    names = _names(seq)
    place = F.struct(*[F.col("raw").getField(n).alias(n) for n in names])
    first = F.min(place if len(names) > 1 else F.col("raw").getField(names[0]))
    size = F.length(F.col("content").cast("string")).cast("bigint")
    return (
        long_form.groupBy("group_value", "group_key", "group_is_null", "message_count")
        .agg(
            F.min_by("role", "position").alias("first_role"),
            F.max_by("role", "position").alias("last_role"),
            F.coalesce(F.sum(size), F.lit(0)).alias("n_chars"),
            first.alias("first_seq"),
        )
        .drop("group_value")
    )


def first_seen(df: DataFrame, cfg: TrajectoryConfig, seq: str) -> DataFrame:
    """Groups with the input position of their first row, which is their output order."""
    check_columns(df, cfg)
    located = _located(df, cfg)
    return (
        located.groupBy(_GROUP)
        .agg(F.min(seq).alias("first_seq"), F.count("*").alias("message_count"))
        .select(
            _group_label(df, cfg).alias("group_key"),
            F.col(_GROUP).isNull().alias("group_is_null"),
            "first_seq",
            "message_count",
        )
    )


def trajectory_warnings(df: DataFrame, cfg: TrajectoryConfig) -> DataFrame:
    """Order and role warnings per group, all from one aggregation over the group."""
    check_columns(df, cfg)
    located = _located(df, cfg)
    mark = _unsortable_mark(located, cfg)
    per_group = located.groupBy(_GROUP).agg(
        F.count("*").alias("n"),
        F.count_if(role_missing(_text(df, cfg.role_column))).alias("n_no_role"),
        (F.lit(False) if mark is None else mark).alias("unsortable"),
    )
    no_order = cfg.order_by is not None and cfg.order_by not in df.columns
    label = _group_label(df, cfg).alias("group_key")

    def warning(code: str, column: str | None, count: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("code"),
                label,
                F.lit(column).cast("string").alias("column"),
                count.cast("bigint").alias("count"),
            ),
        )

    return per_group.select(
        F.inline(
            F.array_compact(
                F.array(
                    warning("MISSING_ORDER_COLUMN", cfg.order_by, F.col("n"), F.lit(no_order)),
                    warning("UNSORTABLE_ORDER_COLUMN", cfg.order_by, F.lit(None), F.col("unsortable")),
                    warning(
                        "MISSING_ROLE_COLUMN", cfg.role_column, F.col("n_no_role"), F.col("n_no_role") > 0
                    ),
                )
            )
        )
    )

