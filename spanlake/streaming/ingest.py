"""Continuous ingest: message streams through the batch transforms into stored tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import otlp, profiles, statsd
from ..sources.tables import BATCH, write_table

#: Signal → (table, schema of its messages if they are JSON export requests, transform).
SIGNALS = {
    "traces": ("spans", otlp.TRACES, otlp.flatten_traces),
    "logs": ("logs", otlp.LOGS, otlp.flatten_logs),
    "metrics": ("metrics", otlp.METRICS, otlp.flatten_metrics),
    "statsd": ("metrics", None, lambda raw: statsd.statsd_rows(raw, F.current_timestamp())),
    "profiles": ("profiles", None, profiles.profile_rows),
}

#: Write pace per table; profiles are flushed less often.
TRIGGERS = {"profiles": {"processingTime": "5 seconds"}}

#: Rows of a micro-batch that one task sorts and writes, more or less.
ROWS_PER_TASK = 1 << 18

#: Columns with a bloom filter in the files of a table.
BLOOMS = {"spans": "trace_id", "logs": "trace_id"}


def stream_ingest(messages: DataFrame, signal: str, path: str, checkpoint: str,
                  trigger: dict | None = None, dead: str | None = None) -> StreamingQuery:
    """Run one signal's ingest into the table at ``path``; undecodable messages go to the table at ``dead``.

    A micro-batch is parsed once and kept while both tables are written.  Each writes the batch to a folder
    of its own, sorted and with bloom filters, and replaces what is there: a batch that runs again after a
    failure adds nothing.  Decodable rows are counted first, so that no task sorts many more than ROWS_PER_TASK.
    The query's progress counts decodable and undecodable messages under the observed metric ``ingest``.  A
    day's batches are packed by :func:`~spanlake.sources.upkeep.compact` once it is over.
    """
    table, schema, transform = SIGNALS[signal]
    rows = messages
    if schema is not None:
        rows = otlp.marked(messages, schema).observe(
            "ingest", F.count(F.when(F.col("reason").isNull(), 1)).alias("good"), F.count("reason").alias("bad"))

    def store(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        if schema is None:
            write_table(transform(batch), path, table, bloom=BLOOMS.get(table), batch=number)
            return
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = transform(held.where("reason IS NULL").drop("reason"))
            write_table(good, path, table, bloom=BLOOMS.get(table), batch=number,
                        parts=good.count() // ROWS_PER_TASK + 1)
            if dead is not None:
                (held.where("reason IS NOT NULL").select("value", "reason", F.lit(number).alias(BATCH))
                 .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(dead))
        finally:
            held.unpersist()

    return (rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGERS.get(table) or {"processingTime": "1 second"})).start())


#: Schema of the dead letters.
DEAD_LETTERS = "value string, reason string"
