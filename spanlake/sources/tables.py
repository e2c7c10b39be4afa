"""Stored telemetry tables: scan, day-partitioned write, retention, narrow copies."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.times import instant
from ..schemas import LAYOUT, RETENTION_DAYS


#: Folder level of streamed tables: the micro-batch that wrote the rows, from 1; 0 once a day is packed.
BATCH = "batch"

#: Bytes of rows, before compression, that a table written piece by piece shuffles at once.
AT_ONCE = 4 << 30

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scan(spark: SparkSession, path: str, schema: T.StructType,
         tenant_id: str = "default") -> DataFrame:
    """One tenant's rows of a stored table.

    Day-partitioned tables come with their ``date`` column; the tenant predicate and the day
    predicate of :func:`~spanlake.functions.times.in_range` prune folders.
    """
    rows = spark.read.schema(schema).parquet(path).where(F.col("tenant_id") == tenant_id)
    return rows.drop(BATCH)


def with_date(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("date", F.to_date(ts))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files are deleted once the query ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def packed(sizes: list[tuple], at_once: int) -> list[list]:
    """Names out of (name, bytes) in their order, in groups of at most ``at_once`` bytes or one name."""
    groups, held = [], 0
    for name, size in sizes:
        if not groups or held + size > at_once:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


def _row_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row: its texts as they are, eight for any other value."""
    total = F.lit(8 * len(rows.columns))
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            total = total + F.octet_length(F.concat_ws("", f.name))
    return total


def _pieces(rows: DataFrame, ts: str, at_once: int, split_days: bool) -> list[Column]:
    """Conditions on rows, of which each row meets one: runs of days of about ``at_once`` bytes.

    A day of more bytes is split by a hash of all that a row holds, with ``split_days``.
    """
    day = F.unix_date(F.to_date(ts))
    found = {r.day: r.bytes for r in rows.groupBy(day.alias("day")).agg(F.sum(_row_bytes(rows)).alias("bytes")).collect()}
    if sum(found.values()) <= at_once:
        return [F.lit(True)]
    timed = packed(sorted((d, n) for d, n in found.items() if d is not None), at_once)
    pieces = []
    for days in ([[None]] if None in found else []) + timed:
        if days == [None]:
            within = F.col(ts).isNull()
        else:
            start, end = (F.date_from_unix_date(F.lit(d)).cast("timestamp") for d in (days[0], days[-1] + 1))
            within = (F.col(ts) >= start) & (F.col(ts) < end)
        parts = -(-found[days[0]] // at_once) if split_days and len(days) == 1 else 1
        if parts == 1:
            pieces.append(within)
        else:
            code = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
            pieces += [within & (code == k) for k in range(parts)]
    return pieces


def write_table(df: DataFrame, path: str, table: str, mode: str = "append", bloom: str | None = None,
                batch: int | None = None, parts: int = 1, at_once: int | None = None) -> None:
    """Write a table by tenant and day, sorted inside each file.

    With ``batch``, rows go to that batch's folder below the day and replace what it held, so writing a batch
    again changes nothing.

    The rebalance hint lets AQE split a tenant-day that is too big for one task and merge the
    small ones, so files come out evenly sized even if one tenant has most of the rows.  The
    sort gives row groups tight min/max bounds; ``bloom`` names a column for a Parquet bloom
    filter (point lookups).

    AQE goes by compressed bytes, which say little about the memory that a task's sort takes.  Who
    knows the number of rows can give ``parts``: ranges in the order of the files, one a task, where
    rows that are equal in it are told apart by a hash of all they hold.

    A shuffle holds a copy of all rows on local disk, and packs them worse than the table does.  With ``at_once``,
    rows are counted first and then written by days, about that many bytes at once, and each shuffle is deleted
    before the next.  ``df`` is read anew for each piece, so it must give the same rows each time.  A run that dies
    leaves the pieces it has written; with ``batch``, writing again replaces them (a day is then one piece).
    """
    if at_once is not None:
        with shuffles_dropped(df.sparkSession):
            for piece in _pieces(df, LAYOUT[table][0], at_once, batch is None and mode == "append"):
                write_table(df.where(piece), path, table, mode, bloom, batch, parts)
        return
    ts, order = LAYOUT[table]
    folders, rows = ["tenant_id", "date"], with_date(df, ts)
    if batch is not None:
        folders, rows, mode = [*folders, BATCH], rows.withColumn(BATCH, F.lit(batch)), "overwrite"
    if parts > 1:
        dealt = rows.repartitionByRange(parts, "tenant_id", "date", *order, F.xxhash64(*rows.columns))
    else:
        dealt = rows.hint("rebalance", "tenant_id", "date")
    writer = (
        dealt.sortWithinPartitions("tenant_id", "date", *order)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(*folders)
    )
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    if mode == "overwrite":
        # Only the days present in df are replaced.
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stream_table(df: DataFrame, path: str, checkpoint: str, table: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Continuous, exactly-once append of a table by tenant and day."""
    return (
        with_date(df, LAYOUT[table][0])
        .writeStream.format("parquet")
        .partitionBy("tenant_id", "date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``."""
    oldest = instant(as_of) - F.make_dt_interval(days=F.lit(int(days)))
    kept = df.where(F.col(ts) >= oldest)
    return kept.where(F.col("date") >= F.to_date(oldest)) if "date" in df.columns else kept


def retention_sweep(df: DataFrame, table: str, as_of) -> DataFrame:
    """Rows of a table that its retention rule still keeps."""
    return retain(df, LAYOUT[table][0], RETENTION_DAYS[table], as_of)


#: Columns of the narrow copy that the scatter view reads.
XVIEW_COLUMNS = ["tenant_id", "service", "env", "start_time", "duration_ns", "status_code",
                 "trace_id", "span_id"]


def xview_projection(spans: DataFrame) -> DataFrame:
    """Narrow copy of spans in scatter-view order, to be stored with ``write_table``."""
    narrow = spans.select(*XVIEW_COLUMNS)
    return narrow.sortWithinPartitions("tenant_id", "service", "start_time")
