"""Streaming forms, run once over the stored tables (available-now) into written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlake.operators import incidents as I, rollup as R
from spanlake.operators.logs import log_entries
from spanlake.session import run_dir
from spanlake.sources import streams, tables
from spanlake.schemas import SPANS
from spanlake.streaming.incidents import CLOCK, incidents_stream, latest_status
from spanlake.streaming.ingest import stream_ingest
from spanlake.streaming.logs import stream_live_tail, stream_log_metrics
from spanlake.streaming.rollup import stream_span_stats

from . import alert_queries as AQ, ingest_queries as IQ, views as V
from .config_tables import MONITOR_VIEWS, rules
from .registry import query

ONCE = {"availableNow": True}


def _events(spark, sf) -> DataFrame:
    V.configure(spark)
    return streams.table_stream(spark, sf, V.EVENTS, "events.parquet")


def _stored(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end of its input and read the table it wrote."""
    spark = stream.sparkSession
    root = run_dir(spark, label)
    run = (stream.writeStream.format("parquet").option("path", f"{root}/table")
           .option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
           .trigger(**ONCE).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


@query("stream_source", "SELECT event_id, epoch_us(ts) AS us, event_type, value FROM events")
def stream_source(spark, sf):
    rows = _events(spark, sf).select("event_id", F.unix_micros("ts").alias("us"), "event_type",
                                     "value")
    return _stored(rows, "source")


@query("stream_ingest", IQ.FLAT_SPANS_SQL, ("spans",))
def stream_traces(spark, sf):
    """Messages land as text files; the ingest stream flattens and stores them by day."""
    root = run_dir(spark, "ingest")
    IQ.trace_messages(spark, sf).write.text(f"{root}/in")
    run = stream_ingest(streams.text_stream(spark, f"{root}/in"), "traces", f"{root}/spans",
                        f"{root}/checkpoint", ONCE)
    run.awaitTermination()
    return IQ.flat_spans(tables.scan(spark, f"{root}/spans", SPANS))


@query("stream_span_stats", """SELECT service, env,
    epoch_us(date_trunc('minute', start_time)) // 1000 AS minute_ms, count(*) AS requests,
    count(*) FILTER (status_code = 2) AS errors, round(avg(duration_ns), 3) AS avg_ns,
    round(quantile_cont(duration_ns, 0.99), 3) AS p99
  FROM spans GROUP BY ALL HAVING date_trunc('minute', any_value(start_time)) + INTERVAL 1 MINUTE
    <= date_trunc('milliseconds', (SELECT max(start_time) FROM spans)) - INTERVAL 5 MINUTE""",
       ("spans",))
def stream_stats(spark, sf):
    """Minutes the watermark has passed; the last five minutes are still open."""
    stats = stream_span_stats(V.span_rows(_events(spark, sf)), exact=True)
    return _stored(stats, "stats").select(
        "service", "env", F.unix_millis("minute").alias("minute_ms"), "requests", "errors",
        F.round("avg_ns", 3).alias("avg_ns"), F.round("p99", 3).alias("p99"))


@query("stream_span_sketches", """WITH done AS (SELECT tenant_id, service, env,
    date_trunc('minute', start_time) AS m, count(*) AS n,
    count(*) FILTER (status_code = 2) AS errors FROM spans GROUP BY ALL
    HAVING m + INTERVAL 1 MINUTE
      <= date_trunc('milliseconds', (SELECT max(start_time) FROM spans)) - INTERVAL 5 MINUTE)
  SELECT tenant_id, service, env, epoch_us(date_trunc('hour', m)) // 1000 AS hour_ms,
    CAST(sum(n) AS bigint) AS requests, CAST(sum(errors) AS bigint) AS errors FROM done
  GROUP BY ALL""", ("spans",))
def stream_sketches(spark, sf):
    """Bounded-state minutes out of the stream, merged into hours afterwards."""
    minutes = _stored(stream_span_stats(V.span_rows(_events(spark, sf))), "sketches")
    hours = R.merge_span_stats(minutes.withColumn("minute", F.date_trunc("hour", "minute")))
    return hours.select("tenant_id", "service", "env", F.unix_millis("minute").alias("hour_ms"),
                        "requests", "errors")


@query("stream_log_metrics", AQ.RULES_SQL, ("logs", "rules"))
def stream_rules(spark, sf):
    logs = V.log_rows(_events(spark, sf), V.table(spark, sf, "documents"))
    return AQ.rule_totals(_stored(stream_log_metrics(logs, rules(spark, sf)), "rules"))


@query("stream_live_tail", """SELECT span_id, severity_text AS severity,
    epoch_us(timestamp) // 1000 AS ts FROM logs WHERE severity_number >= 17
  ORDER BY timestamp DESC, trace_id, span_id LIMIT 500""", ("logs",))
def stream_tail(spark, sf):
    """One trigger's view of the tail, delivered into a table per batch."""
    logs = V.log_rows(_events(spark, sf), V.table(spark, sf, "documents"))
    root = run_dir(spark, "tail")

    def deliver(entries: DataFrame, batch_id: int) -> None:
        entries.write.mode("overwrite").parquet(f"{root}/view/batch={batch_id}")

    run = stream_live_tail(logs, deliver, f"{root}/checkpoint", severity="error", trigger=ONCE)
    run.awaitTermination()
    shape = log_entries(V.logs(spark, sf)).schema
    return spark.read.schema(shape).parquet(f"{root}/view").select("span_id", "severity", "ts")


@query("stream_incidents", AQ.INCIDENT_SQL, MONITOR_VIEWS)
def stream_incident_changes(spark, sf):
    """Evaluations and actions land as files in an order of their own, dealt by a hash of each event;
    the stateful stream takes one file a batch and folds them in event time."""
    root = run_dir(spark, "events")
    line = I.as_events(AQ.evaluations(spark, sf), AQ.known_actions(spark, sf))
    line.repartition(3, F.xxhash64("at", "kind")).write.parquet(f"{root}/in")
    # The watermark has to pass the last events; this row comes in the last file.
    after = spark.sql(f"""SELECT '' AS tenant_id, '' AS monitor_id, TIMESTAMP '{V.END}' + INTERVAL 60 DAY AS at,
        0 AS step, '{CLOCK}' AS kind, CAST(NULL AS DOUBLE) AS value""")
    after.select(line.columns).write.mode("append").parquet(f"{root}/in")
    stream = streams.table_stream(spark, f"{root}/in", line.schema, files_per_trigger=1)
    return AQ.incident_view(latest_status(_stored(incidents_stream(stream, "40 days"), "incidents")))
