"""Query-log analytics: paging, search, expiry, retention, recent activity, counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.errors import AnalyticsError
from turnwise.functions.text import one_line
from turnwise.operators.positions import SortKey, hash_of, orderable, with_positions

# Page sizes, lifetimes and retention.
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
TEMPORARY_DAYS = 7
NAMED_DAYS = 90
HISTORY_DAYS = 30
RECENT_ROWS = 10

# Numbers over which rows without a parent are dealt in a join by parent.
_DEALT = 4096

# Up to this many rows a page is cut from a top-k; deeper pages go by row position.
SHALLOW_ROWS = 10_000


def _newest_first(time: str, key: str) -> list[SortKey]:
    return [
        SortKey(time, ascending=False, nulls_first=False),
        SortKey(key, ascending=False, nulls_first=False),
    ]


def page(
    df: DataFrame,
    time: str,
    key: str,
    number: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    max_rows: int | None = None,
) -> DataFrame:
    """Page ``number`` of the rows, newest first, then by key from high to low."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise AnalyticsError(
            "PAGE_OUT_OF_RANGE", "page starts at 1, size is 1 to 500", {"page": number, "size": size}
        )
    order = _newest_first(time, key)
    skip = (number - 1) * size
    if skip + size <= SHALLOW_ROWS:
        return df.orderBy(*[k.expression() for k in order]).offset(skip).limit(size)
    picked = (skip + 1, skip + size)
    rows = with_positions(
        df, [], order, position="__tw_position", max_rows=max_rows, between=picked
    ).drop("__tw_position")
    # At most one page, so ordering it costs nothing and holds without adaptive execution as well.
    return rows.orderBy(*[k.expression() for k in order])


def page_totals(df: DataFrame, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Total rows and pages; an empty listing has one page."""
    pages = F.greatest(F.expr(f"(total + {int(size) - 1}) div {int(size)}"), F.lit(1))
    return df.agg(F.count("*").alias("total")).select("total", pages.cast("bigint").alias("total_pages"))


def next_page(
    df: DataFrame, time: str, key: str, after_time: Column, after_key: Column, size: int
) -> DataFrame:
    """The page after a known last row; reads no skipped rows into the sort.

    NULL times, and NULL keys among equal times, come last, also as the row to go on from.
    """

    def later(column: str, last: Column) -> Column:
        return F.when(last.isNull(), F.lit(False)).otherwise(
            F.coalesce(F.col(column) < last, F.col(column).isNull())
        )

    rest = later(time, after_time) | (F.col(time).eqNullSafe(after_time) & later(key, after_key))
    order = [k.expression() for k in _newest_first(time, key)]
    return df.where(rest).orderBy(*order).limit(size)


def search(
    df: DataFrame,
    columns: Sequence[str],
    text: str | None = None,
    equals: dict[str, object] | None = None,
    expires: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Rows with ``text`` in any of the columns, ignoring case.

    ``%`` and ``_`` in the text are wildcards. ``equals`` adds equality filters, a value of None
    adding none. With ``expires`` rows that expired before ``now`` are left out; a NULL expiry
    never expires.
    """
    found = df
    for name, value in (equals or {}).items():
        if value is not None:
            found = found.where(F.col(name) == F.lit(value))
    if text:
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        hit = reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])
        found = found.where(hit)
    if expires is not None:
        found = found.where(F.col(expires).isNull() | (F.col(expires) >= F.lit(now)))
    return found


def expiry(created: Column, named: Column, explicit: Column, given: Column) -> Column:
    """Expiry time: an explicit value (even NULL) wins, else 90 days when named, 7 when not."""
    days = F.when(named, F.lit(NAMED_DAYS)).otherwise(F.lit(TEMPORARY_DAYS))
    return F.when(explicit, given).otherwise(created + F.make_dt_interval(days))


@dataclass(frozen=True)
class QueryLog:
    """The query-log tables and the names of the columns retention looks at."""

    queries: DataFrame
    history: DataFrame
    labels: DataFrame
    analyses: DataFrame
    query_key: str = "id"
    expires: str = "expires_at"
    parent: str = "query_id"
    executed: str = "executed_at"


def _expired(log: QueryLog, now: datetime) -> DataFrame:
    return log.queries.where(F.col(log.expires) < F.lit(now)).select(
        F.col(log.query_key).alias("__tw_expired")
    )


def _cutoff(now: datetime) -> Column:
    return F.lit(now) - F.make_dt_interval(F.lit(HISTORY_DAYS))


def retention_report(log: QueryLog, now: datetime) -> DataFrame:
    """What retention would remove, as one row of counts.

    Children are counted per parent before they meet the expired keys, so a parent with very
    many children adds one row to the join.
    """
    expired = _expired(log, now)

    def children(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(log.parent).agg(F.count("*").alias("n"))
        hit = counted.join(expired, F.col(log.parent) == F.col("__tw_expired"), "left_semi")
        return hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("item"), "n")

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")

    items = [
        rows(expired, "expired_queries"),
        rows(log.history.where(F.col(log.executed) < _cutoff(now)), "history_records"),
        children(log.labels, "label_records"),
        children(log.analyses, "analyses"),
    ]
    names = ["expired_queries", "history_records", "label_records", "analyses"]
    return reduce(DataFrame.unionByName, items).agg(
        *[F.max(F.when(F.col("item") == name, F.col("n"))).alias(name) for name in names]
    )


def _dealt(df: DataFrame, parent: str) -> Column:
    """0 for rows with a parent; for the others, which meet nothing, a number that spreads them."""
    others = [f.name for f in df.schema.fields if f.name != parent and orderable(f.dataType)]
    return F.when(F.col(parent).isNull(), F.pmod(hash_of(df, others), F.lit(_DEALT)) + 1 if others else F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def retention_survivors(log: QueryLog, now: datetime) -> QueryLog:
    """The tables after retention; write them to a new place, never over their source.

    Expired queries go and take their labels and analyses along. History keeps its rows with
    the query key emptied, then loses what is older than the retention time. Every table is scanned
    once. The joins carry no hint: adaptive execution broadcasts the expired keys only when they are
    measured to be small and splits skewed parents otherwise. Rows without a parent, of which
    retention makes ever more, are dealt by their other columns. The conditions on times are in a
    form that reaches the scan.
    """
    expired = _expired(log, now).withColumn("__tw_dealt", F.lit(0).cast("bigint"))
    executed, expires = F.col(log.executed), F.col(log.expires)
    same = lambda df: (F.col(log.parent) == F.col("__tw_expired")) & (_dealt(df, log.parent) == F.col("__tw_dealt"))

    def without(df: DataFrame) -> DataFrame:
        return df.join(expired, same(df), "left_anti")

    kept = log.history.where(executed.isNull() | (executed >= _cutoff(now)))
    linked = kept.join(expired, same(kept), "left")
    linked = linked.withColumn(log.parent, F.when(F.col("__tw_expired").isNull(), F.col(log.parent)))
    history = linked.select(kept.columns)
    queries = log.queries.where(expires.isNull() | (expires >= F.lit(now)))
    return QueryLog(
        queries, history, without(log.labels), without(log.analyses),
        log.query_key, log.expires, log.parent, log.executed,
    )


# Column of the day in saved history, and the tables of a saved log.
DAY = "executed_on"
_HISTORY, _DAYS, _SCHEMA = "query_history", "history_days", "history_schema"
_TABLES = {"queries": "named_queries", "labels": "label_records", "analyses": "analyses"}


def save_log(log: QueryLog, directory: str) -> None:
    """Write the tables to a place that does not exist yet; history is partitioned by day.

    Rebalancing by day keeps a day's rows together and lets adaptive execution split a day that
    is too large for one task. A small table says for each day in which folder it lies.
    """
    _save_days(log.history.withColumn(DAY, F.to_date(log.executed)), directory)
    days = log.history.sparkSession.read.schema(f"{DAY} date").parquet(f"{directory}/{_HISTORY}").distinct()
    days.select(DAY, F.lit(directory).alias("folder")).coalesce(1).write.mode("errorifexists").parquet(f"{directory}/{_DAYS}")
    _save_others(log, directory)


def _save_days(history: DataFrame, directory: str) -> None:
    history.hint("rebalance", DAY).write.mode("errorifexists").partitionBy(DAY).parquet(f"{directory}/{_HISTORY}")
    history.limit(0).write.mode("errorifexists").parquet(f"{directory}/{_SCHEMA}")


def _save_others(log: QueryLog, directory: str) -> None:
    for field, name in _TABLES.items():
        getattr(log, field).write.mode("errorifexists").parquet(f"{directory}/{name}")


def _in_days(days: Sequence[date | None]) -> Column:
    """A filter that reaches the partitions; NULL is the day of rows that have no time."""
    known = F.col(DAY).isin([day for day in days if day is not None])
    return known | F.col(DAY).isNull() if None in days else known


def read_log(spark: SparkSession, directory: str, days: Sequence[date | None] | None = None, **columns: str) -> QueryLog:
    """A saved log, its history with the day column, of some days only where these are given.

    Each folder that still holds days is read with a filter on its days, so no other partition is
    opened. ``columns`` names the columns as in :class:`QueryLog`.
    """
    tables = {field: spark.read.parquet(f"{directory}/{name}") for field, name in _TABLES.items()}
    folders: dict[str, list[date | None]] = {}
    for day, folder in _folders(spark, directory).items():
        if days is None or day in days:
            folders.setdefault(folder, []).append(day)
    schema = spark.read.parquet(f"{directory}/{_SCHEMA}").schema
    parts = [spark.read.schema(schema).parquet(f"{folder}/{_HISTORY}").where(_in_days(own)) for folder, own in sorted(folders.items())]
    parts = parts or [spark.createDataFrame([], schema)]
    return QueryLog(tables["queries"], reduce(DataFrame.unionByName, parts), tables["labels"], tables["analyses"], **columns)


def _folders(spark: SparkSession, directory: str) -> dict[date | None, str]:
    """Where each day lies: a row per day of the log, which is as many as the retention time has, and future days."""
    return {r[DAY]: r["folder"] for r in spark.read.parquet(f"{directory}/{_DAYS}").collect()}


def retain_saved(spark: SparkSession, directory: str, new_directory: str, now: datetime, **columns: str) -> list[date | None]:
    """Apply retention to a saved log; the result is a saved log in a new place. Returns the days that were written there.

    Days before the retention time are left out unread. The day at its edge, and the days in which a row has an expired parent, are
    read whole and written anew; these are found by one scan of the parent column. All other days stay where they are, and the new
    log's table of days points there, so the old place must be kept as long as any of its days is in use.
    """
    log = read_log(spark, directory, **columns)
    cutoff = now - timedelta(days=HISTORY_DAYS)
    folders = {day: folder for day, folder in _folders(spark, directory).items() if day is None or day >= cutoff.date()}
    kept = read_log(spark, directory, list(folders), **columns)
    expired = _expired(log, now)
    parents = kept.history.select(DAY, log.parent).where(F.col(log.parent).isNotNull())
    hit = parents.groupBy(DAY, log.parent).agg(F.lit(1)).join(expired, F.col(log.parent) == F.col("__tw_expired"), "left_semi")
    touched = {r[DAY] for r in hit.select(DAY).distinct().collect()} | ({cutoff.date()} & folders.keys())
    part = read_log(spark, directory, sorted(touched, key=str), **columns)
    survivors = retention_survivors(part, now)
    _save_days(survivors.history, new_directory)
    rows = [(day, new_directory if day in touched else folder) for day, folder in folders.items()]
    days = spark.createDataFrame(rows, f"{DAY} date, folder string")
    days.coalesce(1).write.mode("errorifexists").parquet(f"{new_directory}/{_DAYS}")
    _save_others(survivors, new_directory)
    return sorted(touched, key=str)


def recent_activity(
    history: DataFrame,
    connections: DataFrame,
    time: str,
    key: str,
    connection: str,
    connection_key: str,
    connection_name: str,
    rows: int = RECENT_ROWS,
) -> DataFrame:
    """The latest rows with their connection's name, ``#id`` when it is unknown.

    The latest rows are found first, so the join sees only those few; whether the connections
    are broadcast is left to their measured size.
    """
    latest = history.orderBy(*[k.expression() for k in _newest_first(time, key)]).limit(rows)
    names = connections.select(
        F.col(connection_key).alias("__tw_key"), F.col(connection_name).alias("__tw_name")
    )
    named = latest.join(names, F.col("__tw_key") == F.col(connection), "left")
    label = F.coalesce(F.col("__tw_name"), F.concat(F.lit("#"), F.col(connection).cast("string")))
    return named.withColumn("connection_label", label).drop("__tw_key", "__tw_name")


def one_line_preview(sql: Column, length: int) -> Column:
    """SQL text on one line, cut to ``length``."""
    return one_line(sql, length)


def inventory_counts(connections: DataFrame, queries: DataFrame, named: Column) -> DataFrame:
    """Number of connections and of named queries."""
    a = connections.agg(F.count("*").alias("n")).select(F.lit("connections").alias("item"), "n")
    b = queries.agg(F.count_if(named).alias("n")).select(F.lit("named_queries").alias("item"), "n")
    return a.unionByName(b)
