"""Ingest: protocol messages made from the tables by Spark, then flattened back.

The messages are built with to_json from every row of the table, so each query both writes
and reads its format and its result is the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlake.functions import codes, times
from spanlake.functions.anyvalue import any_value_text, any_value_type
from spanlake.session import run_dir
from spanlake.sources import otlp, profiles as PR, statsd, tables
from spanlake.schemas import SPANS

from . import views as V
from .registry import query

_RESOURCE = """named_struct('attributes', array(
    named_struct('key', 'service.name', 'value', named_struct('stringValue', service)),
    named_struct('key', 'deployment.environment', 'value', named_struct('stringValue', env))))"""
_ATTRS = """transform(arrays_zip(attrs_keys, attrs_values), p -> named_struct(
    'key', p.attrs_keys, 'value', named_struct('stringValue', p.attrs_values)))"""
_NANOS = "CAST(unix_micros({ts}) * 1000 AS STRING)"


def _messages(rows: DataFrame, outer: str, middle: str, inner: str, item: str) -> DataFrame:
    """One export request per row, as JSON text."""
    return rows.selectExpr(f"""to_json(named_struct('{outer}', array(named_struct(
        'resource', {_RESOURCE}, '{middle}', array(named_struct('{inner}', array({item}))))
        ))) AS value""")


def trace_messages(spark, sf) -> DataFrame:
    start = _NANOS.format(ts="start_time")
    span = f"""named_struct('traceId', trace_id, 'spanId', span_id, 'parentSpanId', parent_span_id,
        'name', name, 'kind', kind, 'startTimeUnixNano', {start}, 'endTimeUnixNano',
        CAST(unix_micros(start_time) * 1000 + duration_ns AS STRING),
        'status', IF(status_code = 0, NULL, named_struct('code', status_code, 'message', '')),
        'attributes', {_ATTRS})"""
    return _messages(V.spans(spark, sf), "resourceSpans", "scopeSpans", "spans", span)


def log_messages(spark, sf) -> DataFrame:
    record = f"""named_struct('timeUnixNano', {_NANOS.format(ts='timestamp')},
        'severityNumber', severity_number, 'severityText', severity_text,
        'body', named_struct('stringValue', body),
        'traceId', IF(severity_number = 13, '', trace_id),
        'spanId', IF(severity_number = 13, '', span_id), 'attributes', {_ATTRS})"""
    return _messages(V.logs(spark, sf), "resourceLogs", "scopeLogs", "logRecords", record)


def metric_messages(spark, sf) -> DataFrame:
    """Clicks and views as sums, errors as histograms, purchases as summaries, others gauges.

    Every sign-up also carries an exponential histogram, which is to be left out.
    """
    at = f"'timeUnixNano', {_NANOS.format(ts='timestamp')}"
    number = f"named_struct('dataPoints', array(named_struct({at}, 'asDouble', value)))"
    summed = f"named_struct('dataPoints', array(named_struct({at}, 'sum', value)))"
    metric = f"""named_struct('name', name,
        'sum', IF(name IN ('app.click', 'app.view'), {number}, NULL),
        'histogram', IF(name = 'app.error', {summed}, NULL),
        'summary', IF(name = 'app.purchase', {summed}, NULL),
        'gauge', IF(name = 'app.signup', {number}, NULL),
        'exponentialHistogram', IF(name = 'app.signup', {summed}, NULL))"""
    return _messages(V.metrics(spark, sf), "resourceMetrics", "scopeMetrics", "metrics", metric)


FLAT_SPANS_SQL = """SELECT tenant_id, trace_id, span_id, parent_span_id, name, service, env, kind,
    epoch_us(start_time) AS start_us, duration_ns, status_code,
    array_to_string(attrs_keys, ',') AS attr_keys, array_to_string(attrs_values, ',') AS attr_vals
  FROM spans"""


def flat_spans(df: DataFrame) -> DataFrame:
    return df.select(
        "tenant_id", "trace_id", "span_id", "parent_span_id", "name", "service", "env", "kind",
        F.unix_micros("start_time").alias("start_us"), "duration_ns", "status_code",
        F.array_join("attrs_keys", ",").alias("attr_keys"),
        F.array_join("attrs_values", ",").alias("attr_vals"))


@query("otlp_traces_flatten", FLAT_SPANS_SQL, ("spans",))
def otlp_traces_flatten(spark, sf):
    return flat_spans(otlp.flatten_traces(trace_messages(spark, sf)))


@query("otlp_logs_flatten", """SELECT tenant_id, epoch_us(timestamp) AS us, trace_id, span_id,
    severity_number, severity_text, service, env, body, attrs_values[1] AS duration_ms FROM logs""",
       ("logs",))
def otlp_logs_flatten(spark, sf):
    return otlp.flatten_logs(log_messages(spark, sf)).select(
        "tenant_id", F.unix_micros("timestamp").alias("us"), "trace_id", "span_id",
        "severity_number", "severity_text", "service", "env", "body",
        F.get("attrs_values", 0).alias("duration_ms"))


_METRIC_TYPES = """CASE name WHEN 'app.click' THEN 1 WHEN 'app.view' THEN 1 WHEN 'app.error' THEN 2
    WHEN 'app.purchase' THEN 3 ELSE 0 END"""


@query("otlp_metrics_flatten", f"""SELECT tenant_id, epoch_us(timestamp) // 1000 AS t, name,
    {_METRIC_TYPES} AS type, value, service, env FROM metrics""", ("metrics",))
def otlp_metrics_flatten(spark, sf):
    return otlp.flatten_metrics(metric_messages(spark, sf)).select(
        "tenant_id", F.unix_millis("timestamp").alias("t"), "name", "type", "value", "service",
        "env")


@query("dlq_split", """SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN event_id % 10 = 3 THEN 'malformed JSON' ELSE 'good' END AS reason
    FROM events) GROUP BY 1""")
def dlq_split(spark, sf):
    """Every tenth message is cut off in the middle; both branches are counted."""
    eid = F.col("span_id").cast("long") - 4
    raw = V.spans(spark, sf).select(eid.alias("event_id")).withColumn(
        "value", F.format_string('{"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "s%d"}]}]}]}',
                                 "event_id"))
    cut = raw.withColumn("value", F.when(F.col("event_id") % 10 == 3, F.substring("value", 1, 30))
                         .otherwise(F.col("value")))
    good, bad = otlp.split_bad(cut, otlp.TRACES)
    both = good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def statsd_packets(spark, sf) -> DataFrame:
    """Per event a packet of a timer, a sampled counter and a line that does not parse."""
    return V.table(spark, sf, "events").selectExpr(
        "event_id AS packet_id", "ts",
        r"""concat('ev.', event_type, ':', CAST(value AS STRING), '|ms|#service:svc-',
            CAST(user_id % 5 AS STRING), ',env:', IF(user_id % 2 = 0, 'prod', 'staging'),
            ',flag', '\n', 'ev.hits:', CAST(user_id AS STRING), IF(event_id % 2 = 0, '|c@0.5',
            '|c|@0.5'), '\n', 'ev.bad:x|g') AS value""")


_STATSD_SQL = """WITH base AS (SELECT *, concat('svc-', CAST(user_id % 5 AS string)) AS service,
    CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS env FROM events)
  SELECT concat('ev.', event_type) AS name, 0 AS type, value, service, env, 'service,env,flag'
    AS attr_keys, concat(service, ',', env, ',') AS attr_vals, epoch_us(ts) AS us FROM base
  UNION ALL SELECT 'ev.hits', 1, user_id / 0.5, service, env, '', '', epoch_us(ts) FROM base"""


@query("statsd_ingest", _STATSD_SQL)
def statsd_ingest(spark, sf):
    rows = statsd.statsd_rows(statsd_packets(spark, sf), F.col("ts"))
    return rows.select(
        "name", "type", "value", "service", "env",
        F.array_join("attrs_keys", ",").alias("attr_keys"),
        F.array_join("attrs_values", ",").alias("attr_vals"),
        F.unix_micros("timestamp").alias("us"))


@query("statsd_packet_resource", f"SELECT service, env, type, count(*) AS n FROM ({_STATSD_SQL}) "
       "GROUP BY ALL")
def statsd_packet_resource(spark, sf):
    rows = statsd.statsd_rows(statsd_packets(spark, sf), F.col("ts"))
    return rows.groupBy("service", "env", "type").agg(F.count(F.lit(1)).alias("n"))


@query("profiles_ingest", """SELECT 'default' AS tenant_id, epoch_us(timestamp) AS us, service, env,
    type, payload, 32 AS id_chars FROM profiles WHERE CAST(profile_id AS bigint) % 10 <> 3""",
       ("profiles",))
def profiles_ingest(spark, sf):
    """Every tenth message is cut off and dropped; absent fields take their defaults."""
    made = V.profiles(spark, sf).selectExpr(
        "CAST(profile_id AS BIGINT) AS n", """to_json(named_struct('service', service, 'env', env,
        'profile_type', IF(type = 'cpu', NULL, type), 'timestamp_ns',
        unix_micros(timestamp) * 1000, 'data_base64', payload)) AS value""")
    raw = made.withColumn("value", F.when(F.col("n") % 10 == 3, F.substring("value", 1, 25))
                          .otherwise(F.col("value")))
    return PR.profile_rows(raw).select(
        "tenant_id", F.unix_micros("timestamp").alias("us"), "service", "env", "type", "payload",
        F.length("profile_id").alias("id_chars"))


@query("partitioned_sink", FLAT_SPANS_SQL + " WHERE start_time >= TIMESTAMP '2024-01-10 00:00:00' "
       "AND start_time < TIMESTAMP '2024-01-12 12:00:00'", ("spans",))
def partitioned_sink(spark, sf):
    """All spans written by tenant and day; a time range read back prunes to three days."""
    from spanlake.functions.times import in_range

    path = run_dir(spark, "spans")
    tables.write_table(V.spans(spark, sf), path, "spans", bloom="trace_id")
    stored = tables.scan(spark, path, SPANS)
    return flat_spans(in_range(stored, "start_time", "2024-01-10 00:00:00",
                               "2024-01-12 12:00:00"))


@query("xview_projection", "SELECT tenant_id, service, env, epoch_us(start_time) AS us, duration_ns, "
       "status_code, trace_id, span_id FROM spans", ("spans",))
def xview_projection(spark, sf):
    return tables.xview_projection(V.spans(spark, sf)).withColumn(
        "us", F.unix_micros("start_time")).drop("start_time")


@query("retention_sweep", "SELECT span_id, epoch_us(start_time) AS us FROM spans WHERE start_time >= "
       "TIMESTAMP '2024-02-14 06:00:00' - INTERVAL 30 DAY", ("spans",))
def retention_sweep(spark, sf):
    kept = tables.retention_sweep(V.spans(spark, sf), "spans", "2024-02-14 06:00:00")
    return kept.select("span_id", F.unix_micros("start_time").alias("us"))


@query("enum_names", """SELECT span_id,
    (['Unspecified', 'Internal', 'Server', 'Client', 'Producer', 'Consumer'])[kind + 1] AS kind_name,
    CASE status_code WHEN 1 THEN 'Ok' WHEN 2 THEN 'Error' ELSE 'Unset' END AS status_name,
    CASE name WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warn' WHEN 'view' THEN 'Debug'
      ELSE 'Info' END AS severity FROM spans""", ("spans",))
def enum_names(spark, sf):
    number = F.expr("CASE name WHEN 'error' THEN 18 WHEN 'signup' THEN 16 WHEN 'view' THEN 5 "
                    "ELSE 99 END")
    return V.spans(spark, sf).select(
        "span_id", codes.span_kind(F.col("kind")).alias("kind_name"),
        codes.status_name(F.col("status_code")).alias("status_name"),
        codes.severity_band(number).alias("severity"))


@query("hex_ids", """SELECT event_id, lower(hex(event_type)) AS raw,
    rpad(substr(lower(hex(event_type)), 1, 16), 16, '0') AS wide,
    rpad(substr(lower(hex(event_type)), 1, 8), 8, '0') AS narrow FROM events""")
def hex_ids(spark, sf):
    raw = F.lower(F.hex("event_type"))
    return V.table(spark, sf, "events").select(
        "event_id", raw.alias("raw"), codes.hex_id(F.hex("event_type"), 16).alias("wide"),
        codes.hex_id(raw, 8).alias("narrow"))


@query("any_value_text", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type
    WHEN 1 THEN CAST(event_id AS string) WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'true'
      ELSE 'false' END
    WHEN 3 THEN concat('[', event_type, ',', CAST(user_id AS string), ']')
    ELSE concat('{a=', event_type, ',b=', CAST(user_id AS string), '}') END AS text FROM events""")
def any_value_texts(spark, sf):
    """Attribute values of five kinds, parsed from JSON and rendered as text."""
    made = V.table(spark, sf, "events").selectExpr("event_id", """CASE event_id % 5
        WHEN 0 THEN to_json(named_struct('stringValue', event_type))
        WHEN 1 THEN to_json(named_struct('intValue', CAST(event_id AS STRING)))
        WHEN 2 THEN to_json(named_struct('boolValue', user_id % 2 = 0))
        WHEN 3 THEN concat('{"arrayValue":{"values":[{"stringValue":"', event_type,
          '"},{"doubleValue":', CAST(CAST(user_id AS DOUBLE) AS STRING), '}]}}')
        ELSE concat('{"kvlistValue":{"values":[{"key":"a","value":{"stringValue":"', event_type,
          '"}},{"key":"b","value":{"intValue":"', CAST(user_id AS STRING), '"}}]}}') END AS json""")
    parsed = made.select("event_id", F.from_json("json", any_value_type()).alias("v"))
    return parsed.select("event_id", any_value_text("v").alias("text"))


@query("any_value_deep", """SELECT event_id, CASE event_id % 3
    WHEN 0 THEN concat(repeat('[', CAST(3 + user_id % 8 AS int)), event_type, ',7', repeat(']', CAST(3 + user_id % 8 AS int)))
    WHEN 1 THEN concat(repeat('{k=', CAST(3 + user_id % 8 AS int)), event_type, repeat('}', CAST(3 + user_id % 8 AS int)))
    ELSE concat('[x,', repeat('{k=[', CAST(1 + user_id % 5 AS int)), event_type, repeat(']}', CAST(1 + user_id % 5 AS int)), ',y]')
    END AS text FROM events""")
def any_value_deep(spark, sf):
    """Arrays and key-value lists nested three to twelve deep, alone and in turn."""
    listed, pair = '{"arrayValue":{"values":[', '{"kvlistValue":{"values":[{"key":"k","value":'
    text = """concat('{"stringValue":"', event_type, '"}')"""
    many, some = "CAST(3 + user_id % 8 AS INT)", "CAST(1 + user_id % 5 AS INT)"
    made = V.table(spark, sf, "events").selectExpr("event_id", f"""CASE event_id % 3
        WHEN 0 THEN concat(repeat('{listed}', {many}), {text}, ',{{"intValue":"7"}}', repeat(']}}}}', {many}))
        WHEN 1 THEN concat(repeat('{pair}', {many}), {text}, repeat('}}]}}}}', {many}))
        ELSE concat('{listed}{{"stringValue":"x"}},', repeat('{pair}{listed}', {some}), {text},
          repeat(']}}}}}}]}}}}', {some}), ',{{"stringValue":"y"}}]}}}}') END AS json""")
    parsed = made.select("event_id", F.from_json("json", any_value_type()).alias("v"))
    return parsed.select("event_id", any_value_text("v").alias("text"))


@query("compare_ops", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN value > 50
    WHEN 1 THEN value >= 50 WHEN 2 THEN value < 50 WHEN 3 THEN value <= 50
    ELSE abs(value - 50) < 2.220446049250313e-16 END AS violated FROM events""")
def compare_ops(spark, sf):
    op = F.element_at(F.array(*[F.lit(o) for o in ("gt", "gte", "lt", "lte", "eq")]),
                      (F.col("event_id") % 5 + 1).cast("int"))
    return V.table(spark, sf, "events").select(
        "event_id", codes.violated(op, F.col("value"), F.lit(50.0)).alias("violated"))


@query("payload_roundtrip", "SELECT profile_id, length(payload) AS base64_chars, "
       "CAST(decode(from_base64(payload)) AS string) AS text FROM profiles", ("profiles",))
def payload_roundtrip(spark, sf):
    return V.profiles(spark, sf).select(
        "profile_id", F.length("payload").alias("base64_chars"),
        F.decode(F.unbase64("payload"), "utf-8").alias("text"))


@query("natural_ids", """SELECT event_id, substr(sha256(concat('default', chr(1), event_type, chr(1),
    CAST(event_id AS string))), 1, 32) AS id FROM events""")
def natural_ids(spark, sf):
    return V.table(spark, sf, "events").select("event_id", codes.natural_id(
        F.lit("default"), F.col("event_type"), F.col("event_id")).alias("id"))


@query("time_functions", """SELECT event_id, epoch_us(date_trunc('minute', ts)) // 1000000 AS minute_s,
    epoch_us(ts) // 1000 AS ms, CAST(strftime(ts, '%Y%m%d') AS int) AS day,
    CAST(floor(epoch_us(ts) / 900000000) * 900000 AS bigint) AS quarter_ms,
    ts >= TIMESTAMP '2024-01-30 23:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' AS last_hour
  FROM events""")
def time_functions(spark, sf):
    since, until = times.recent(V.END, times.DEFAULT_MINUTES["patterns"])
    ts = F.col("ts")
    return V.table(spark, sf, "events").select(
        "event_id", F.unix_seconds(times.bucket_start(ts)).alias("minute_s"),
        F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyyMMdd").cast("int").alias("day"),
        times.bucket_ms(ts, 900).alias("quarter_ms"),
        ((ts >= since) & (ts < until)).alias("last_hour"))
