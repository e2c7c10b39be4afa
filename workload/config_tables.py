"""Rules and monitors: configuration rows made from the nation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import SQL_VIEWS, table

_K = "n_nationkey"

# Filter type and value by nation key modulo 8; the last four repeat the types.
RULE_CHOICES = [
    ("severity", "ERROR"), ("service", "svc-1"), ("keyword", "nd"), ("body_regex", "th[ae]t?ou"),
    ("severity", "WARN"), ("service", "svc-3"), ("keyword", "les"),
    ("body_regex", "[0-9]{3}-[0-9]{4}"),
]
AGGREGATIONS = ["error_rate", "p99", "avg", "count", "median"]
KINDS = ["metric", "trace", "log"]
OPS = ["gt", "gte", "lt", "lte", "eq"]


def _choice(values: list[str], number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1)
                        .cast("int"))


def _sql_choice(values: list[str], number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{number} % {len(values)} + 1]"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    return table(spark, sf_dir, "nation").select(
        F.lit("default").alias("tenant_id"), F.lpad(k.cast("string"), 8, "0").alias("rule_id"),
        F.concat(F.lit("log.rule."), k.cast("string")).alias("metric_name"),
        F.col("n_name").alias("description"),
        _choice([t for t, _ in RULE_CHOICES], k).alias("filter_type"),
        _choice([v for _, v in RULE_CHOICES], k).alias("filter_value"),
        F.when(k % 3 == 0, "duration_ms").when(k % 3 == 1, "").otherwise("missing")
        .alias("value_field"),
        F.when(k % 3 == 0, 0).otherwise(1).alias("metric_type"),
        F.lit("service,env").alias("group_by"), (k % 5 != 4).alias("enabled"),
        F.timestamp_seconds(F.lit(1704067200) + (k * 7 % 25) * 3600).alias("created_at"))


SQL_VIEWS["rules"] = f"""SELECT 'default' AS tenant_id,
      lpad(CAST({_K} AS string), 8, '0') AS rule_id,
      concat('log.rule.', CAST({_K} AS string)) AS metric_name, n_name AS description,
      {_sql_choice([t for t, _ in RULE_CHOICES], _K)} AS filter_type,
      {_sql_choice([v for _, v in RULE_CHOICES], _K)} AS filter_value,
      CASE {_K} % 3 WHEN 0 THEN 'duration_ms' WHEN 1 THEN '' ELSE 'missing' END AS value_field,
      CASE WHEN {_K} % 3 = 0 THEN 0 ELSE 1 END AS metric_type, 'service,env' AS group_by,
      {_K} % 5 <> 4 AS enabled,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours({_K} * 7 % 25) AS created_at
    FROM nation"""


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    return table(spark, sf_dir, "nation").select(
        F.lit("default").alias("tenant_id"),
        F.concat(F.lit("mon-"), k.cast("string")).alias("monitor_id"),
        F.col("n_name").alias("name"), _choice(KINDS, k).alias("kind"),
        F.concat(F.lit("svc-"), (k % 6).cast("string")).alias("service"),
        _choice(AGGREGATIONS, k).alias("aggregation"),
        ((k % 3 + 1) * 2400).cast("int").alias("window_secs"), _choice(OPS, k).alias("op"),
        F.when(k % 5 == 0, 0.3).when(k % 5 == 1, 120.0).when(k % 5 == 2, 40.0)
        .when(k % 5 == 3, 2.0).otherwise(1.0).alias("threshold"),
        _choice(["critical", "warning", "info"], k).alias("severity"),
        (k % 7 != 6).alias("enabled"),
        F.when(k % 2 == 0, 3600).otherwise(5395).cast("int").alias("interval_secs"))


SQL_VIEWS["monitors"] = f"""SELECT 'default' AS tenant_id,
      concat('mon-', CAST({_K} AS string)) AS monitor_id, n_name AS name,
      {_sql_choice(KINDS, _K)} AS kind, concat('svc-', CAST({_K} % 6 AS string)) AS service,
      {_sql_choice(AGGREGATIONS, _K)} AS aggregation, ({_K} % 3 + 1) * 2400 AS window_secs,
      {_sql_choice(OPS, _K)} AS op,
      CAST(CASE {_K} % 5 WHEN 0 THEN 0.3 WHEN 1 THEN 120 WHEN 2 THEN 40 WHEN 3 THEN 2 ELSE 1 END
           AS double) AS threshold,
      {_sql_choice(["critical", "warning", "info"], _K)} AS severity, {_K} % 7 <> 6 AS enabled,
      CASE WHEN {_K} % 2 = 0 THEN 3600 ELSE 5395 END AS interval_secs
    FROM nation"""

# Ticks and values of every enabled monitor over January.
SQL_VIEWS["ticks"] = """SELECT m.*, t.tick FROM monitors m, LATERAL (
      SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
        TIMESTAMP '2024-01-30 23:59:59',
        to_seconds(CAST(ceil(m.interval_secs / 10.0) * 10 AS int)))) AS tick) t
    WHERE m.enabled"""
SQL_VIEWS["monitor_values"] = """SELECT t.tenant_id, t.monitor_id, t.tick, t.op, t.threshold,
      CASE WHEN t.kind = 'log' THEN CAST(coalesce(l.errors, 0) AS double)
           WHEN t.aggregation = 'error_rate' THEN coalesce(s.errors, 0) / greatest(coalesce(s.n, 0), 1)
           WHEN t.aggregation = 'p99' THEN s.p99 / 1e6
           WHEN t.aggregation = 'avg' THEN s.ns / s.n / 1e6
           ELSE CAST(coalesce(s.n, 0) AS double) END AS value
    FROM ticks t
    LEFT JOIN (SELECT t.monitor_id, t.tick, count(*) AS n,
        count(*) FILTER (s.status_code = 2) AS errors, sum(CAST(s.duration_ns AS double)) AS ns,
        quantile_cont(s.duration_ns, 0.99) AS p99
      FROM ticks t JOIN spans s ON s.service = t.service AND s.start_time < t.tick
        AND s.start_time >= t.tick - to_seconds(t.window_secs) GROUP BY ALL) s
      ON s.monitor_id = t.monitor_id AND s.tick = t.tick
    LEFT JOIN (SELECT t.monitor_id, t.tick, count(*) FILTER (s.status_code = 2) AS errors
      FROM ticks t JOIN spans s ON s.service = t.service AND s.start_time < t.tick
        AND s.start_time >= t.tick - to_seconds(t.window_secs) GROUP BY ALL) l
      ON l.monitor_id = t.monitor_id AND l.tick = t.tick"""
SQL_VIEWS["evaluations"] = """SELECT tenant_id, monitor_id, tick, value,
      coalesce(CASE op WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold
        WHEN 'lt' THEN value < threshold WHEN 'lte' THEN value <= threshold
        ELSE abs(value - threshold) < 2.220446049250313e-16 END, false) AS violated
    FROM monitor_values"""
MONITOR_VIEWS = ("spans", "monitors", "ticks", "monitor_values", "evaluations")
