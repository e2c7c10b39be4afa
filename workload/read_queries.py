"""Scans, predicates, log search, metric queries and listings."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from spanlake.functions import attrs, text, times
from spanlake.functions.codes import series_labels
from spanlake.operators import logs as L, metrics as M, profiles as P, xview as X
from spanlake.plans import findings

from . import views as V
from .registry import query

_XVIEW_POINTS = """SELECT epoch_us(start_time) // 1000 AS t, duration_ns AS d,
  CASE WHEN status_code = 2 THEN 1 ELSE 0 END AS s, trace_id AS tr FROM spans"""


@query("scan_table", "SELECT tenant_id, trace_id, span_id, service, env, kind, duration_ns, "
       "status_code FROM spans WHERE tenant_id = 'default'", ("spans",))
def scan_table(spark, sf):
    return V.spans(spark, sf).where(F.col("tenant_id") == "default").select(
        "tenant_id", "trace_id", "span_id", "service", "env", "kind", "duration_ns",
        "status_code")


@query("time_range_filter", "SELECT span_id, epoch_us(start_time) // 1000 AS t FROM spans WHERE start_time "
       ">= TIMESTAMP '2024-01-05 06:00:00' AND start_time < TIMESTAMP '2024-01-20 18:30:00'",
       ("spans",))
def time_range_filter(spark, sf):
    rows = times.in_range(V.spans(spark, sf), "start_time", "2024-01-05 06:00:00",
                          "2024-01-20 18:30:00")
    return rows.select("span_id", F.unix_millis("start_time").alias("t"))


@query("time_range_closed", "SELECT profile_id, epoch_us(timestamp) // 1000 AS t FROM profiles WHERE "
       "timestamp BETWEEN TIMESTAMP '2024-01-01 00:07:00' AND TIMESTAMP '2024-01-01 01:10:00'",
       ("profiles",))
def time_range_closed(spark, sf):
    rows = times.in_range(V.profiles(spark, sf), "timestamp", "2024-01-01 00:07:00",
                          "2024-01-01 01:10:00", closed=True)
    return rows.select("profile_id", F.unix_millis("timestamp").alias("t"))


@query("service_env_filter", "SELECT span_id, service, env FROM spans WHERE service = 'svc-2' "
       "AND env = 'prod'", ("spans",))
def service_env_filter(spark, sf):
    return X.service_env(V.spans(spark, sf), "svc-2", "prod").select("span_id", "service", "env")


@query("severity_min_filter", "SELECT severity_text, count(*) AS n FROM logs WHERE "
       "severity_number >= 13 GROUP BY 1", ("logs",))
def severity_min_filter(spark, sf):
    rows = L.severity_min_filter(V.logs(spark, sf), "warning")
    return rows.groupBy("severity_text").agg(F.count(F.lit(1)).alias("n"))


@query("trace_id_filter", "SELECT trace_id, span_id, severity_text, epoch_us(timestamp) // 1000 AS t FROM "
       "logs WHERE trace_id = lpad('400', 32, '0')", ("logs",))
def trace_id_filter(spark, sf):
    return L.trace_filter(V.logs(spark, sf), "400".rjust(32, "0")).select(
        "trace_id", "span_id", "severity_text", F.unix_millis("timestamp").alias("t"))


_SEP = r"[\x00-/:-@\[-`{-\x7F]"


@query("fulltext_token_filter", f"""SELECT span_id, severity_text, epoch_us(timestamp) // 1000 AS t,
  length(body) AS chars FROM logs WHERE regexp_matches(body, '(^|{_SEP})nd($|{_SEP})')
  AND regexp_matches(body, '(^|{_SEP})hesh($|{_SEP})')""", ("logs",))
def fulltext_token_filter(spark, sf):
    rows = L.filter_logs(V.logs(spark, sf), query="nd  hesh")
    return rows.select("span_id", "severity_text", F.unix_millis("timestamp").alias("t"),
                       F.length("body").alias("chars"))


@query("body_regex_filter", "SELECT span_id, service, epoch_us(timestamp) // 1000 AS t FROM logs WHERE "
       "regexp_matches(body, '[0-9]{3}-[0-9]{4}')", ("logs",))
def body_regex_filter(spark, sf):
    return L.regex_filter(V.logs(spark, sf), "[0-9]{3}-[0-9]{4}").select(
        "span_id", "service", F.unix_millis("timestamp").alias("t"))


@query("attr_filter", "SELECT span_id, name FROM spans WHERE list_contains(attrs_keys, 'k') AND "
       "attrs_values[list_position(attrs_keys, 'k')] = '42'", ("spans",))
def attr_filter(spark, sf):
    return attrs.attr_filter(V.spans(spark, sf), "k", "42").select("span_id", "name")


@query("tag_guardrails", """SELECT span_id, 1 AS attrs_dropped, 'k' AS keys,
  substr(attrs_values[2], 1, 512) AS vals FROM spans""", ("spans",))
def tag_guardrails(spark, sf):
    rows = V.spans(spark, sf)
    # 'Event Type' holds characters that keys may not have.
    rows = rows.withColumn("attrs_keys", F.array(F.lit("Event Type"), F.lit("k")))
    kept = attrs.guard_attrs(rows)
    return kept.select("span_id", "attrs_dropped", F.array_join("attrs_keys", ",").alias("keys"),
                       F.array_join("attrs_values", ",").alias("vals"))


@query("xview_points", _XVIEW_POINTS + f" WHERE start_time >= {V.SQL_START} AND start_time < "
       f"{V.SQL_END} ORDER BY start_time, trace_id, span_id LIMIT 500000", ("spans",))
def xview_points(spark, sf):
    return X.xview_points(V.spans(spark, sf), V.START, V.END)


@query("xview_points_limited", _XVIEW_POINTS + " WHERE service = 'svc-1' ORDER BY start_time, "
       "trace_id, span_id LIMIT 700", ("spans",))
def xview_points_limited(spark, sf):
    return X.xview_points(V.spans(spark, sf), service="svc-1", limit=700)


_STATS = """SELECT count(*) AS total, count(*) FILTER (status_code = 2) AS errors,
  CAST(trunc(quantile_cont(duration_ns, 0.5)) AS bigint) AS p50,
  CAST(trunc(quantile_cont(duration_ns, 0.95)) AS bigint) AS p95,
  CAST(trunc(quantile_cont(duration_ns, 0.99)) AS bigint) AS p99 FROM spans"""


@query("xview_stats", f"{_STATS} WHERE start_time >= {V.SQL_START} AND start_time < {V.SQL_END}",
       ("spans",))
def xview_stats(spark, sf):
    return X.xview_stats(V.spans(spark, sf), V.START, V.END)


@query("xview_stats_filtered", f"{_STATS} WHERE service = 'svc-3' AND env = 'staging'",
       ("spans",))
def xview_stats_filtered(spark, sf):
    return X.xview_stats(V.spans(spark, sf), service="svc-3", env="staging")


@query("error_percent", """WITH s AS (SELECT count(*) AS total,
  count(*) FILTER (status_code = 2) AS errors FROM spans)
  SELECT total, errors, round(errors / greatest(total, 1) * 100, 9) AS error_percent,
  errors / greatest(total, 1) * 100 > 1 AS flagged FROM s""", ("spans",))
def error_percent(spark, sf):
    out = X.error_percent(X.xview_stats(V.spans(spark, sf), V.START, V.END))
    return out.withColumn("error_percent", F.round("error_percent", 9))


_RECT = (1704326400000, 1705190400000, 20_000_000, 90_000_000)
_IN_RECT = (f"t BETWEEN {_RECT[0]} AND {_RECT[1]} AND d BETWEEN {_RECT[2]} AND {_RECT[3]}")


@query("xview_select_rect", f"SELECT * FROM ({_XVIEW_POINTS}) WHERE {_IN_RECT}", ("spans",))
def xview_select_rect(spark, sf):
    return X.select_rect(X.as_points(V.spans(spark, sf)), *_RECT)


@query("xview_normalize", f"""WITH p AS ({_XVIEW_POINTS}), b AS (SELECT
    min(t) - (max(t) - min(t)) * CAST(0.02 AS double) AS x0,
    max(t) + (max(t) - min(t)) * CAST(0.02 AS double) AS x1,
    ln(1 + greatest(CAST(0 AS double), min(d) - (max(d) - min(d)) * CAST(0.02 AS double))) AS y0,
    ln(1 + max(d) + (max(d) - min(d)) * CAST(0.02 AS double)) AS y1 FROM p)
  SELECT t, d, s, tr, round((t - x0) / (x1 - x0), 6) AS nx,
    round((ln(CAST(1 + d AS double)) - y0) / (y1 - y0), 6) AS ny FROM p, b""", ("spans",))
def xview_normalize(spark, sf):
    out = X.normalize(X.as_points(V.spans(spark, sf)))
    return out.withColumns({"nx": F.round("nx", 6), "ny": F.round("ny", 6)})


@query("xview_normalize_range", f"""WITH p AS ({_XVIEW_POINTS}), b AS (SELECT
    ln(1 + greatest(CAST(0 AS double), min(d) - (max(d) - min(d)) * CAST(0.02 AS double))) AS y0,
    ln(1 + max(d) + (max(d) - min(d)) * CAST(0.02 AS double)) AS y1 FROM p)
  SELECT t, d, s, tr, round((t - 1704067200000) / CAST(2592000000 AS double), 6) AS nx,
    round((ln(CAST(1 + d AS double)) - y0) / (y1 - y0), 6) AS ny FROM p, b""", ("spans",))
def xview_normalize_range(spark, sf):
    out = X.normalize(X.as_points(V.spans(spark, sf)), 1704067200000, 1706659200000)
    return out.withColumns({"nx": F.round("nx", 6), "ny": F.round("ny", 6)})


@query("selection_to_transactions", f"""SELECT span_id, name, service, duration_ns FROM spans
  WHERE trace_id IN (SELECT tr FROM ({_XVIEW_POINTS}) WHERE {_IN_RECT})""", ("spans",))
def selection_to_transactions(spark, sf):
    rows = V.spans(spark, sf)
    picked = X.select_rect(X.as_points(rows), *_RECT).select(F.col("tr").alias("trace_id"))
    return X.selected_transactions(rows, picked, "trace_id").select(
        "span_id", "name", "service", "duration_ns")


@query("transactions_table", f"""WITH sel AS (SELECT * FROM ({_XVIEW_POINTS}) WHERE {_IN_RECT})
  SELECT *, CASE WHEN d / 1e6 > 1000 THEN 'slow' WHEN d / 1e6 > 300 THEN 'medium' ELSE 'fast' END
    AS band, greatest((SELECT count(*) FROM sel) - 100, 0) AS overflow
  FROM sel ORDER BY t, tr, d LIMIT 100""", ("spans",))
def transactions_table(spark, sf):
    return X.transactions_table(X.select_rect(X.as_points(V.spans(spark, sf)), *_RECT))


_ENTRY = """SELECT concat(trace_id, ':', span_id, ':', CAST(epoch_us(timestamp) // 1000 AS string)) AS id,
  epoch_us(timestamp) // 1000 AS ts, service, severity_text AS severity, body, trace_id, span_id,
  attrs_values[1] AS duration_ms FROM logs"""


def _flat_entries(entries):
    return entries.withColumn("duration_ms", F.col("attrs")["duration_ms"]).drop("attrs")


@query("log_entry", _ENTRY, ("logs",))
def log_entry(spark, sf):
    return _flat_entries(L.log_entries(V.logs(spark, sf)))


@query("logs_search", _ENTRY + f""" WHERE timestamp >= {V.SQL_START} AND timestamp < {V.SQL_END}
  AND severity_number >= 13 AND regexp_matches(body, '(^|{_SEP})nd($|{_SEP})')
  ORDER BY timestamp DESC, trace_id, span_id LIMIT 1000""", ("logs",))
def logs_search(spark, sf):
    return _flat_entries(L.logs_search(V.logs(spark, sf), V.START, V.END, severity="WARN",
                                       query="nd"))


@query("live_tail", _ENTRY + """ WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00'
  AND timestamp < TIMESTAMP '2024-01-31 00:00:00' ORDER BY timestamp DESC, trace_id, span_id
  LIMIT 100""", ("logs",))
def live_tail(spark, sf):
    return _flat_entries(L.live_tail(V.logs(spark, sf), V.END, "12 hours"))


_SERIES = """SELECT {labels} CAST(floor(epoch_us(timestamp) / 3600000000) * 3600000 AS bigint) AS t,
  round({agg}, 6) AS v FROM metrics WHERE name = '{name}' GROUP BY ALL"""


def _register_range(agg: str, sql_agg: str) -> None:
    @query(f"query_range_{agg}" if agg != "avg" else "query_range",
           _SERIES.format(labels="", agg=sql_agg, name="app.click"), ("metrics",))
    def run(spark, sf):
        series = M.query_range(V.metrics(spark, sf), "app.click", V.START, V.END, 3600, agg)
        return series.withColumn("v", F.round("v", 6))


for _agg, _sql in (("avg", "avg(value)"), ("sum", "sum(value)"), ("max", "max(value)"),
                   ("min", "min(value)")):
    _register_range(_agg, _sql)


@query("query_range_grouped", _SERIES.format(labels="service, env,", agg="max(value)",
                                             name="app.error"), ("metrics",))
def query_range_grouped(spark, sf):
    series = M.query_range(V.metrics(spark, sf), "app.error", V.START, V.END, 3600, "max",
                           group_by=["env", "service", "host"])
    return series.withColumn("v", F.round("v", 6))


@query("metric_rate", _SERIES.format(labels="", agg="sum(value) / 3600.0", name="app.view"),
       ("metrics",))
def metric_rate(spark, sf):
    series = M.query_range(V.metrics(spark, sf), "app.view", V.START, V.END, 3600, "rate")
    return series.withColumn("v", F.round("v", 6))


@query("metric_rate_grouped", _SERIES.format(labels="service,", agg="sum(value) / 3600.0",
                                             name="app.view"), ("metrics",))
def metric_rate_grouped(spark, sf):
    series = M.query_range(V.metrics(spark, sf), "app.view", V.START, V.END, 3600, "rate",
                           group_by=["service"])
    return series.withColumn("v", F.round("v", 6))


@query("query_range_series", """WITH s AS (SELECT service,
    CAST(floor(epoch_us(timestamp) / 86400000000) * 86400000 AS bigint) AS t, max(value) AS v
  FROM metrics WHERE name = 'app.click' GROUP BY ALL)
  SELECT concat('service=', service) AS series, service, count(*) AS points, min(t) AS first_t,
    max(t) AS last_t FROM s GROUP BY service""", ("metrics",))
def query_range_series(spark, sf):
    labels = ["service"]
    series = M.query_range(V.metrics(spark, sf), "app.click", step=86400, agg="max",
                           group_by=labels)
    rows = M.with_series_key(M.as_series(series, labels), labels)
    data = F.col("data")
    return rows.select("series", series_labels(F.col("series"))["service"].alias("service"),
                       F.size(data).cast("long").alias("points"),
                       data[0]["t"].alias("first_t"),
                       F.element_at(data, -1)["t"].alias("last_t"))


@query("list_metrics", "SELECT DISTINCT name, service FROM metrics ORDER BY 1, 2 LIMIT 1000",
       ("metrics",))
def list_metrics(spark, sf):
    return M.list_metrics(V.metrics(spark, sf))


@query("list_services", "SELECT service, env FROM spans UNION SELECT service, env FROM metrics "
       "ORDER BY 1, 2 LIMIT 100", ("spans", "metrics"))
def list_services(spark, sf):
    return M.list_services(V.spans(spark, sf), V.metrics(spark, sf))


@query("profiles_list", """SELECT profile_id AS id, service, type, epoch_us(timestamp) // 1000 AS timestamp,
  CAST(length(payload) * 3 // 4 AS bigint) AS size_bytes FROM profiles WHERE service = 'svc-2'
  AND type = 'cpu' ORDER BY timestamp DESC, profile_id LIMIT 100""", ("profiles",))
def profiles_list(spark, sf):
    return P.profiles_list(V.profiles(spark, sf), "svc-2", V.START, V.END, "cpu", limit=1000)


@query("profile_by_id", "SELECT profile_id, service, type, payload FROM profiles WHERE profile_id "
       "= lpad('77', 32, '0') LIMIT 1", ("profiles",))
def profile_by_id(spark, sf):
    return P.profile_by_id(V.profiles(spark, sf), "77".rjust(32, "0")).select(
        "profile_id", "service", "type", "payload")


_TOPICS = ["is slow on", "traffic at", "failed in", "is up, says"]
_SQL_WORDS = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{tag}'"
    for tag, words in text.INTENT_KEYWORDS.items())


@query("intent_tag", f"""WITH m AS (SELECT text FROM conversations UNION ALL
  SELECT concat(event_type, ' ', (['is slow on', 'traffic at', 'failed in', 'is up, says'])
    [event_id % 4 + 1], ' svc-', CAST(user_id % 5 AS string)) FROM events)
  SELECT text, CASE {_SQL_WORDS} ELSE 'general' END AS intent FROM m""")
def intent_tag(spark, sf):
    topic = F.element_at(F.array(*[F.lit(t) for t in _TOPICS]),
                         (F.col("event_id") % 4 + 1).cast("int"))
    asked = V.table(spark, sf, "events").select(F.concat(
        "event_type", F.lit(" "), topic, F.lit(" svc-"),
        (F.col("user_id") % 5).cast("string")).alias("text"))
    messages = V.table(spark, sf, "conversations").select("text").unionByName(asked)
    return findings.tag_intent(messages)


@query("auto_step_range", """SELECT service, CAST(floor(epoch_us(timestamp) / 21600000000) * 21600000 AS bigint) AS t,
    round(avg(value), 6) AS v FROM metrics WHERE name = 'app.click' GROUP BY ALL""", ("metrics",))
def auto_step_range(spark, sf):
    """A month's series per service in the step that its range gets by itself: six hours."""
    ends = [int(datetime.fromisoformat(t).replace(tzinfo=UTC).timestamp() * 1000) for t in (V.START, V.END)]
    series = M.query_range(V.metrics(spark, sf), "app.click", V.START, V.END, step=times.auto_step(*ends), group_by=["service"])
    return series.withColumn("v", F.round("v", 6))
