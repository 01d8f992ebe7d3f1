"""Row positions inside ordered groups, safe for groups of any size.

``row_number()`` over a group sorts the whole group in one task. That is right for ordinary
groups and is what runs here when every group is small. When a group is larger than
``max_group_rows`` (say a session with a third of all rows, or the whole table when there is no
group), it is cut into ranges of the sort order first:

1. group sizes, from the key columns only;
2. for oversized groups, cut points of the sort order, taken from a hash sample of the keys;
3. every row gets the number of its range by a search tree of the cut points, node by node;
4. rows per range are counted, which gives each range its offset;
5. ``row_number()`` runs per (group, range) and the offset is added.

Where rows are only numbered (no bytes bound the ranges, no sums run on, no page is picked), 2 to 5 are one sort over Spark's range partitions:
the sorted rows are saved in the shared folder, rows per group and range counted there, and no row is searched for.

The cut points only decide how rows are spread; positions are exact whatever they are. A range has
about ``max_group_rows`` rows however large the table is, and where ``max_bytes`` is given also about
so many bytes at most: a row enters the sample with a chance that grows with its size, and stands
there for what it and its unsampled neighbours weigh; there is one cut point (a few bytes) per
range, and the offsets of the ranges are broadcast only where they are known to be few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwise.errors import AnalyticsError
from turnwise.sources.shared import fresh_path

MAX_GROUP_ROWS = 200_000
MAX_GROUP_ROWS_SETTING = "turnwise.maxGroupRows"
MAX_GROUP_BYTES_SETTING = "turnwise.maxGroupBytes"
# Sampled rows per range, fewer where the sample of a group would be larger than this.
_SAMPLES_PER_RANGE, _MIN_SAMPLES, _SAMPLE_ROWS = 32, 4, 2_000_000
# Ranges whose offsets are broadcast; beyond that they are joined like any table.
_BROADCAST_RANGES = 100_000
# Binary digits of a range that one node of the tree of cut points decides, at most.
_NODE_BITS = 6

_ALL = "__tw_all"
_ROWS = "__tw_rows"
_POINTS = "__tw_points"
_NODE = "__tw_node"
_FIRST = "__tw_first"
_RANGE = "__tw_range"
_OFFSET = "__tw_offset"
_END = "__tw_end"
_LOCAL = "__tw_local"
_HOT = "__tw_hot_"
_BYTES = "__tw_bytes"
_RUNNING = "__tw_running"


@dataclass(frozen=True)
class SortKey:
    """One column of a sort order."""

    column: str
    ascending: bool = True
    nulls_first: bool = True

    def expression(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def precedes(self, left: Column, right: Column) -> Column:
        """True when ``left`` sorts strictly before ``right``; never NULL."""
        smaller = left < right if self.ascending else left > right
        first, second = (left, right) if self.nulls_first else (right, left)
        return F.coalesce(smaller, first.isNull() & second.isNotNull())


def max_group_rows(df: DataFrame, given: int | None) -> int:
    if given is not None:
        return given
    return int(df.sparkSession.conf.get(MAX_GROUP_ROWS_SETTING, str(MAX_GROUP_ROWS)))


def max_group_bytes(df: DataFrame, given: int | None) -> int | None:
    found = given if given is not None else df.sparkSession.conf.get(MAX_GROUP_BYTES_SETTING, None)
    return None if found is None else int(found)


def row_bytes(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """About the bytes of a row: those of texts and binaries, of nested values those of their JSON text, 8 for any other column."""

    def size(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(field.dataType, (T.VariantType, T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(column))
        return F.lit(8)

    sizes = [F.coalesce(size(f), F.lit(0)).cast("bigint") for f in df.schema.fields if columns is None or f.name in columns]
    return reduce(lambda a, b: a + b, sizes, F.lit(0).cast("bigint"))


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[SortKey],
    *,
    position: str = "position",
    total: str | None = None,
    max_rows: int | None = None,
    between: tuple[int, int] | None = None,
    max_bytes: int | None = None,
    weight: Column | None = None,
    running: str | None = None,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Add 1-based positions per group; ``order`` must end in columns that make it a total order.

    ``total`` also adds the number of rows of the group. An empty ``group`` numbers the table;
    then ``between`` keeps the rows of some positions only, and of a large table nothing else is
    shuffled. ``max_bytes`` bounds the ranges of large groups by ``weight`` as well (``row_bytes`` if
    that is not given; counting them reads all columns). ``running`` adds the sum of the weights of
    all earlier rows of the group. ``sized`` is a cheaper frame with the same groups (and rows), from
    which sizes are counted.
    """
    if between and group:
        raise AnalyticsError("POSITIONS_INVALID", "positions can be picked of a whole table only")
    target = max_group_rows(df, max_rows)
    keys = list(group)
    names = df.columns
    weight = row_bytes(df) if weight is None else weight
    if max_bytes is not None or running:
        df = df.withColumn(_BYTES, weight.cast("bigint"))
    sized = df if sized is None else sized if max_bytes is None else sized.withColumn(_BYTES, weight.cast("bigint"))
    if not keys:
        df, sized, keys = df.withColumn(_ALL, F.lit(0)), sized.withColumn(_ALL, F.lit(0)), [_ALL]
    # What a row takes of a range that is full at 1.
    share = F.lit(1.0 / target)
    if max_bytes is not None:
        share = F.greatest(share, F.col(_BYTES) / F.lit(float(max_bytes)))
    sizes = sized.groupBy(*_columns(keys)).agg(F.sum(share).alias(_ROWS))
    cut = F.col(_ROWS) > 1 + 1e-9
    summary = sizes.agg(F.sum(_ROWS).alias("n"), F.max(_ROWS).alias("m"), F.sum(F.when(cut, F.col(_ROWS))).alias("cut"), F.count_if(cut).alias("groups")).head()
    full, largest = (summary["n"] or 0), (summary["m"] or 0)
    if largest <= 1 + 1e-9:
        result = _small_groups(df, keys, order, position, total, running)
    elif max_bytes is None and not running and not between and _can_be_saved(df):
        result = _sorted_ranges(df, keys, order, position, total, sizes.where(cut), summary["groups"], summary["cut"] * target, target)
    else:
        result = _split_groups(df, keys, order, position, total, running, sizes, share, full, largest, between)
    if between:
        result = result.where(F.col(f"`{position}`").between(*between))
    return result.select(*_columns([*names, position, *([total] if total else []), *([running] if running else [])]))


def _small_groups(
    df: DataFrame, keys: list[str], order: Sequence[SortKey], position: str, total: str | None, running: str | None
) -> DataFrame:
    window = Window.partitionBy(*_columns(keys))
    if running:
        df = df.withColumn(running, _before(window.orderBy(*[k.expression() for k in order])))
    numbered = df.withColumn(
        position, F.row_number().over(window.orderBy(*[k.expression() for k in order])).cast("bigint")
    )
    return numbered.withColumn(total, F.count("*").over(window)) if total else numbered


def _can_be_saved(df: DataFrame) -> bool:
    """Whether Parquet holds all columns."""
    return not any(word in f.dataType.simpleString() for f in df.schema.fields for word in ("void", "interval"))


def _sorted_ranges(
    df: DataFrame,
    keys: list[str],
    order: Sequence[SortKey],
    position: str,
    total: str | None,
    sizes: DataFrame,
    groups: int,
    rows: float,
    target: int,
) -> DataFrame:
    """Positions by one sort of the large groups (``sizes``: these), range by range; the others are sorted whole, each in a task.

    Sorted rows are saved with a number that goes on within a range, so a position is that number less the first one of its group there, plus
    the group's rows in earlier ranges. No row is compared with cut points outside Spark's own range partitioning. A range has ``target`` rows,
    or more where that makes more ranges than shuffle partitions, but no more than ``MAX_GROUP_ROWS`` then.
    """
    spark = df.sparkSession
    ranges = max(min(ceil(rows / target), int(spark.conf.get("spark.sql.shuffle.partitions"))), ceil(rows / max(target, MAX_GROUP_ROWS)))
    hot, large, small = _rename_keys(sizes, keys), df, None
    if keys != [_ALL]:
        hot = F.broadcast(hot) if groups <= _BROADCAST_RANGES else hot
        large, small = df.join(hot, _same_keys(keys), "left_semi"), df.join(hot, _same_keys(keys), "left_anti")
    by = [*([] if keys == [_ALL] else [c.asc_nulls_first() for c in _columns(keys)]), *[k.expression() for k in order]]
    placed = large.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = placed.withColumns({_RANGE: F.spark_partition_id(), _LOCAL: F.monotonically_increasing_id()})
    path = fresh_path(spark, "positions")
    placed.write.parquet(path)
    saved = spark.read.schema(placed.schema).parquet(path)

    earlier = Window.partitionBy(*_columns(keys)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = saved.groupBy(*_columns(keys), _RANGE).agg(F.count("*").alias(_ROWS), F.min(_LOCAL).alias(_FIRST))
    offsets = parts.select(
        *[F.col(f"`{k}`").alias(_HOT + k) for k in keys],
        F.col(_RANGE).alias(_HOT + _RANGE),
        (F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)) - F.col(_FIRST) + 1).alias(_OFFSET),
        F.sum(_ROWS).over(Window.partitionBy(*_columns(keys))).alias(_ROWS),
    )
    same_range = F.col(_RANGE) == F.col(_HOT + _RANGE)
    if keys != [_ALL]:
        same_range = _same_keys(keys) & same_range
    # A group has a row here for each range that it reaches into.
    found = saved.join(F.broadcast(offsets) if ranges + groups <= _BROADCAST_RANGES else offsets, same_range)
    found = found.withColumn(position, F.col(_LOCAL) + F.col(_OFFSET))
    if total:
        found = found.withColumn(total, F.col(_ROWS))
    names = [*df.columns, position, *([total] if total else [])]
    found = found.select(*_columns(names))
    if small is None:
        return found
    return found.unionByName(_small_groups(small, keys, order, position, total, None).select(*_columns(names)))


def _before(window) -> Column:
    """The sum of the weights of all earlier rows."""
    return F.coalesce(F.sum(_BYTES).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")


def _split_groups(
    df: DataFrame,
    keys: list[str],
    order: Sequence[SortKey],
    position: str,
    total: str | None,
    running: str | None,
    sizes: DataFrame,
    share: Column,
    full: float,
    largest: float,
    between: tuple[int, int] | None,
) -> DataFrame:
    # Twice the expected number of cut points; the search may stop short of further ones.
    steps = int(2 * largest + 1).bit_length()
    few = 4 * full <= _BROADCAST_RANGES
    names = dict.fromkeys([*keys, *[k.column for k in order], *([_BYTES] if _BYTES in df.columns else [])])
    narrow = df.select(*_columns(list(names)))
    hot = _rename_keys(sizes.where(F.col(_ROWS) > 1 + 1e-9), keys)
    points = _cut_points(narrow, hot, keys, order, share, largest)

    ranged_keys = _with_ranges(narrow, points, keys, order, steps, "inner")
    per_group = Window.partitionBy(*_columns(keys))
    weights = [F.sum(_BYTES).alias(_BYTES)] if running else []
    offsets = ranged_keys.groupBy(*_columns(keys), _RANGE).agg(F.count("*").alias(_ROWS), *weights)
    if running:
        offsets = offsets.withColumn(_RUNNING, _before(per_group.orderBy(_RANGE)))
    offsets = offsets.select(
        *[F.col(f"`{k}`").alias(_HOT + k) for k in keys],
        F.col(_RANGE).alias(_HOT + _RANGE),
        F.coalesce(
            F.sum(_ROWS).over(
                per_group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias(_OFFSET),
        F.sum(_ROWS).over(
            per_group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
        ).alias(_END),
        F.sum(_ROWS).over(per_group).alias(_ROWS),
        *([_RUNNING] if running else []),
    )

    ranged = _with_ranges(df, points, keys, order, steps, "left")
    same_range = F.col(_RANGE) == F.col(_HOT + _RANGE)
    if keys != [_ALL]:
        same_range = _same_keys(keys) & same_range
    how = "left"
    if between:
        offsets = offsets.where((F.col(_OFFSET) < between[1]) & (F.col(_END) >= between[0]))
        how = "inner"
    # Groups that are not cut find none; a picked page lies in very few ranges.
    ranged = ranged.join(F.broadcast(offsets) if few or between else offsets, same_range, how)
    window = Window.partitionBy(*_columns(keys), _RANGE)
    local = F.row_number().over(window.orderBy(*[k.expression() for k in order]))
    ranged = ranged.withColumn(position, local + F.coalesce(F.col(_OFFSET), F.lit(0)))
    if total:
        ranged = ranged.withColumn(total, F.coalesce(F.col(_ROWS), F.count("*").over(window)))
    if running:
        local_before = _before(window.orderBy(*[k.expression() for k in order]))
        ranged = ranged.withColumn(running, local_before + F.coalesce(F.col(_RUNNING), F.lit(0)))
    return ranged


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]


def _rename_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(_HOT + k) for k in keys])


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{_HOT + k}`")) for k in keys])


def hash_of(df: DataFrame, names: Sequence[str]) -> Column:
    """Hash of several columns; texts by their bytes, whatever their collation."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return F.xxhash64(
        *[F.col(f"`{n}`").cast("binary") if n in texts else F.col(f"`{n}`") for n in dict.fromkeys(names)]
    )


def _cut_points(
    narrow: DataFrame, hot: DataFrame, keys: list[str], order: Sequence[SortKey], share: Column, largest: float
) -> DataFrame:
    """One row per oversized group: its cut points in sort order.

    Only all order columns together tell rows apart, so the sample goes by the hash of all of them. A row is drawn with the chance of its
    share times the samples per range, so a row that fills as much as such a sample is always there.
    """
    per_range = max(_MIN_SAMPLES, min(_SAMPLES_PER_RANGE, int(_SAMPLE_ROWS / largest)))
    drawn = F.pmod(hash_of(narrow, [*keys, *[k.column for k in order]]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = narrow.withColumn(_ROWS, share).where(drawn < F.col(_ROWS) * per_range)
    sampled = sampled.withColumn(_ROWS, F.greatest(F.col(_ROWS), F.lit(1.0 / per_range)))
    # Without a group, all rows belong together; the oversized groups join the sample only.
    sample = sampled if keys == [_ALL] else sampled.join(hot, _same_keys(keys), "left_semi")
    ranks = Window.partitionBy(*_columns(keys)).orderBy(*[k.expression() for k in order])
    # A cut stands before the first row with which another range begins; sums of shares may err in their last digits, the same each time.
    stood = F.coalesce(F.sum(_ROWS).over(ranks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    earlier = stood - F.lag(_ROWS, 1, 0.0).over(ranks)
    numbered = sample.withColumns({_LOCAL: F.row_number().over(ranks), _RANGE: F.floor(stood + 1e-9), _END: F.floor(earlier + 1e-9)})
    cuts = numbered.where(F.col(_RANGE) > F.col(_END))
    point = F.struct(*[F.col(f"`{k.column}`").alias(f"k{i}") for i, k in enumerate(order)])
    return cuts.groupBy(*[F.col(f"`{k}`").alias(_HOT + k) for k in keys]).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(_LOCAL).alias("n"), point.alias("p")))),
            lambda s: s["p"],
        ).alias(_POINTS)
    )


def _tree(points: DataFrame, keys: list[str], levels: int, bits: int) -> DataFrame:
    """The cut points of each group as nodes of a search tree, each with fewer than ``2 ** bits`` of them, whatever their number.

    The digits of a row's range, to the base ``2 ** bits``, are found from the highest on. The node for a digit is named by its level and by the
    digits before it, and holds every ``2 ** (bits * level)``-th cut point among those that are left.
    """
    cuts, fan = F.col(_POINTS), 1 << bits

    def nodes(level: int) -> Column:
        width = 1 << (bits * level)
        found = (F.size(cuts) / F.lit(width)).cast("int")  # cut points of this level

        def node(prefix: Column) -> Column:
            held = F.slice(F.sequence(F.lit(0), F.lit(fan - 1)), F.lit(2), F.least(F.lit(fan - 1), found - prefix * fan))
            taken = F.transform(held, lambda digit: F.get(cuts, (prefix * fan + digit) * width - 1))
            return F.struct(_node(level, prefix).alias(_NODE), taken.alias(_POINTS))

        return F.transform(F.sequence(F.lit(0), (found / F.lit(fan)).cast("int")), node)

    every = F.concat(*[nodes(level) for level in range(levels)])
    return points.select(*[F.col(f"`{_HOT + k}`") for k in keys], F.explode(every).alias(_NODE)).select(
        *[F.col(f"`{_HOT + k}`") for k in keys], F.col(f"{_NODE}.{_NODE}").alias(_NODE), F.col(f"{_NODE}.{_POINTS}").alias(_POINTS)
    )


def _node(level: int, prefix: Column) -> Column:
    return F.lit(level << 40) + prefix.cast("bigint")


def _with_ranges(
    df: DataFrame,
    points: DataFrame,
    keys: list[str],
    order: Sequence[SortKey],
    steps: int,
    how: str,
) -> DataFrame:
    """Number of cut points at or before each row, 0 for groups that are not cut.

    A row meets one small node of the search tree at a time: an array of all cut points beside each row would be copied with it, which
    takes time by rows times cut points.
    """
    levels = -(-steps // _NODE_BITS)
    bits = -(-steps // levels)
    tree = _tree(points, keys, levels, bits)

    def reached(point: Column, index: int = 0) -> Column:
        key = order[index]
        cut, own = point[f"k{index}"], F.col(f"`{key.column}`")
        if index == len(order) - 1:
            return ~key.precedes(own, cut)
        return key.precedes(cut, own) | (cut.eqNullSafe(own) & reached(point, index + 1))

    def step(found: Column, size: Column) -> Column:
        candidate = found + size
        return F.when(
            (candidate <= F.size(_POINTS)) & reached(F.get(F.col(_POINTS), candidate - 1)), candidate
        ).otherwise(found)

    halvings = F.array(*[F.lit(1 << bit) for bit in range(bits - 1, -1, -1)])
    digit = F.when(F.col(_POINTS).isNull(), F.lit(0)).otherwise(F.aggregate(halvings, F.lit(0), step))
    hot = [_HOT + k for k in keys]
    root = tree.where(F.col(_NODE) == F.lit((levels - 1) << 40)).drop(_NODE)
    if keys == [_ALL]:
        df = df.withColumn(_POINTS, root.select(_POINTS).scalar())
    else:
        # Cut points in all are fewer than rows by rows per range.
        df = df.join(F.broadcast(root), _same_keys(keys), how).drop(*hot)
    df = df.withColumn(_RANGE, digit).drop(_POINTS)
    for level in range(levels - 2, -1, -1):
        same_node = _node(level, F.col(_RANGE)) == F.col(_NODE)
        if keys != [_ALL]:
            same_node = _same_keys(keys) & same_node
        joined = df.join(F.broadcast(tree), same_node, "left")
        df = joined.withColumn(_RANGE, F.col(_RANGE) * F.lit(1 << bits) + digit).drop(_POINTS, _NODE, *hot)
    return df


def orderable(data_type: T.DataType) -> bool:
    """Whether Spark can sort this type by value."""
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return False
    if isinstance(data_type, T.ArrayType):
        return orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(orderable(f.dataType) for f in data_type.fields)
    return True
