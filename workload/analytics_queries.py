"""Rollups, service aggregates, findings, anomalies and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlake.operators import rollup as R
from spanlake.plans import anomaly as A, findings as G, patterns as P

from . import views as V
from .registry import query

BUCKET = "1 hour"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(n, digits) for n in names})


_HOUR = "epoch_us(date_trunc('hour', start_time)) // 1000"


@query("span_stats_1m", """SELECT tenant_id, service, env,
    epoch_us(date_trunc('minute', start_time)) // 1000 AS minute_ms, count(*) AS requests,
    count(*) FILTER (status_code = 2) AS errors, round(quantile_cont(duration_ns, 0.5), 3) AS p50,
    round(quantile_cont(duration_ns, 0.95), 3) AS p95,
    round(quantile_cont(duration_ns, 0.99), 3) AS p99, round(avg(duration_ns), 3) AS avg_ns
  FROM spans GROUP BY ALL""", ("spans",))
def span_stats_1m(spark, sf):
    stats = R.span_stats(V.spans(spark, sf))
    out = stats.withColumn("minute_ms", F.unix_millis("minute")).drop("minute")
    return rounded(out, "p50", "p95", "p99", "avg_ns", digits=3)


@query("span_stats_merge", """SELECT tenant_id, service, env,
    epoch_us(date_trunc('day', start_time)) // 1000 AS minute_ms, count(*) AS requests,
    count(*) FILTER (status_code = 2) AS errors, round(avg(duration_ns), 3) AS avg_ns,
    true AS quantiles_close
  FROM spans GROUP BY ALL""", ("spans",))
def span_stats_merge(spark, sf):
    """Minutes merged into days; each estimate's true rank must lie within 2 % (or one row)."""
    rows = V.spans(spark, sf)
    parts = R.span_sketches(rows).withColumn("minute", F.date_trunc("day", "minute"))
    merged = R.merge_span_stats(parts)
    days = rows.withColumn("minute", F.date_trunc("day", "start_time"))
    ranked = days.select(*R.KEYS, "duration_ns").join(merged, R.KEYS).groupBy(
        *R.KEYS, "requests", "errors", "avg_ns").agg(*[
            F.count_if(F.expr(f"duration_ns {op} {q}")).alias(f"{q}_{side}")
            for q in R.QUANTILES for side, op in (("below", "<"), ("upto", "<="))])
    close = F.lit(True)
    for name, q in R.QUANTILES.items():
        slack = F.col("requests") * 0.02 + 1
        close = (close & (F.col(f"{name}_below") <= F.col("requests") * q + slack)
                 & (F.col(f"{name}_upto") >= F.col("requests") * q - slack))
    return ranked.select(
        "tenant_id", "service", "env", F.unix_millis("minute").alias("minute_ms"), "requests",
        F.col("errors").cast("long").alias("errors"), F.round("avg_ns", 3).alias("avg_ns"),
        close.alias("quantiles_close"))


_RATE = "count(*) FILTER (status_code = 2) / count(*)"


@query("service_error_rate", f"SELECT service, round({_RATE}, 9) AS error_rate, count(*) AS total "
       f"FROM spans GROUP BY 1 ORDER BY {_RATE} DESC, service LIMIT 5", ("spans",))
def service_error_rate(spark, sf):
    return rounded(G.service_error_rate(V.spans(spark, sf), V.START, V.END), "error_rate",
                   digits=9)


_P99 = "quantile_cont(duration_ns, 0.99) / 1e6"


@query("service_latency", f"SELECT service, round({_P99}, 6) AS p99_ms, "
       f"round(avg(duration_ns) / 1e6, 6) AS avg_ms FROM spans GROUP BY 1 "
       f"ORDER BY {_P99} DESC, service LIMIT 5", ("spans",))
def service_latency(spark, sf):
    return rounded(G.service_latency(V.spans(spark, sf), V.START, V.END), "p99_ms", "avg_ms")


@query("service_traffic", "SELECT service, count(*) AS cnt FROM spans GROUP BY 1 "
       "ORDER BY 2 DESC, 1 LIMIT 10", ("spans",))
def service_traffic(spark, sf):
    return G.service_traffic(V.spans(spark, sf), V.START, V.END)


_OVERVIEW = (f"SELECT service, {_RATE} AS error_rate, count(*) AS total FROM spans GROUP BY 1 "
             "ORDER BY total DESC, service LIMIT {limit}")


@query("service_overview", f"SELECT service, round(error_rate, 9) AS error_rate, total FROM "
       f"({_OVERVIEW.format(limit=10)})", ("spans",))
def service_overview(spark, sf):
    return rounded(G.service_overview(V.spans(spark, sf), V.START, V.END), "error_rate", digits=9)


@query("system_summary", f"SELECT CAST(sum(total) AS bigint) AS total_requests, "
       f"bool_or(error_rate > 0.01) AS has_errors, count(*) AS services FROM "
       f"({_OVERVIEW.format(limit=5)})", ("spans",))
def system_summary(spark, sf):
    return G.system_summary(V.spans(spark, sf), V.START, V.END)


@query("minute_counts", "SELECT service, epoch_us(date_trunc('minute', start_time)) // 1000 AS "
       "minute_ms, count(*) AS cnt FROM spans GROUP BY ALL", ("spans",))
def minute_counts(spark, sf):
    counts = P.minute_counts(V.spans(spark, sf), V.START, V.END)
    return counts.select("service", F.unix_millis("minute").alias("minute_ms"), "cnt")


_HEALTH = f"""SELECT tenant_id, {_HOUR} AS minute_ms, {_RATE} AS error_rate, {_P99} AS p99_ms,
  count(*) AS total FROM spans GROUP BY ALL"""


@query("minute_health", f"SELECT tenant_id, minute_ms, round(error_rate, 9) AS error_rate, "
       f"round(p99_ms, 6) AS p99_ms, total FROM ({_HEALTH})", ("spans",))
def minute_health(spark, sf):
    health = A.minute_health(V.spans(spark, sf), V.START, V.END, BUCKET)
    out = health.select("tenant_id", F.unix_millis("minute").alias("minute_ms"),
                        F.round("error_rate", 9).alias("error_rate"), "p99_ms", "total")
    return rounded(out, "p99_ms")


_SCORES = f"""WITH h AS (SELECT * FROM ({_HEALTH}) WHERE minute_ms >= {{since}}
    AND minute_ms < 1706659200000),
  r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY minute_ms DESC) AS back,
    count(*) OVER (PARTITION BY tenant_id) AS buckets FROM h),
  u AS (SELECT tenant_id, 'error_rate' AS metric, error_rate AS v, back, minute_ms FROM r
    WHERE buckets >= 5 UNION ALL
    SELECT tenant_id, 'p99_latency_ms', p99_ms, back, minute_ms FROM r WHERE buckets >= 5),
  s AS (SELECT tenant_id, metric, max(v) FILTER (back = 1) AS cur, avg(v) FILTER (back > 1) AS mean,
    stddev_pop(v) FILTER (back > 1) AS sd, max(minute_ms) AS minute_ms FROM u GROUP BY ALL),
  z AS (SELECT concat('tenant:', tenant_id) AS service, metric,
    CASE WHEN sd > 0 THEN abs(cur - mean) / sd ELSE 0 END AS score, mean, cur, minute_ms FROM s)
  SELECT service, metric, round(score, 6) AS score, round(mean, 6) AS baseline,
    round(cur, 6) AS current, minute_ms{{extra}} FROM z"""


def _anomalies(df: DataFrame) -> DataFrame:
    out = df.withColumn("minute_ms", F.unix_millis("minute")).drop("minute")
    return rounded(out, "score", "baseline", "current")


@query("anomaly_zscore", _SCORES.format(since=1706572800000, extra=""), ("spans",))
def anomaly_zscore(spark, sf):
    return _anomalies(A.anomaly_scores(V.spans(spark, sf), V.END, 1440, BUCKET))


@query("last_vs_history", f"""WITH h AS ({_HEALTH}), r AS (SELECT *, row_number() OVER
    (PARTITION BY tenant_id ORDER BY minute_ms DESC) AS back FROM h)
  SELECT tenant_id, max(total) FILTER (back = 1) AS last_total,
    CAST(sum(total) FILTER (back > 1) AS bigint) AS earlier_total, count(*) - 1 AS history
  FROM r GROUP BY 1""", ("spans",))
def last_vs_history(spark, sf):
    """The last bucket against all earlier ones, over the whole range."""
    health = A.minute_health(V.spans(spark, sf), V.START, V.END, BUCKET)
    last = health.groupBy("tenant_id").agg(
        F.max_by("total", "minute").alias("last_total"), F.sum("total").alias("_all"),
        (F.count(F.lit(1)) - 1).alias("history"))
    return last.select("tenant_id", "last_total",
                       (F.col("_all") - F.col("last_total")).alias("earlier_total"), "history")


@query("anomaly_band", _SCORES.format(since=1706572800000, extra=", CASE WHEN score > 3 THEN 'red' "
       "WHEN score > 2 THEN 'amber' ELSE 'blue' END AS band"), ("spans",))
def anomaly_band(spark, sf):
    scores = A.anomaly_scores(V.spans(spark, sf), V.END, 1440, BUCKET)
    return _anomalies(scores.withColumn("band", A.anomaly_band(F.col("score"))))


@query("detect_anomalies", _SCORES.format(since=1706572800000, extra="") + " WHERE score > 0.5",
       ("spans",))
def detect_anomalies(spark, sf):
    return _anomalies(A.detect_anomalies(V.spans(spark, sf), V.END, 1440, BUCKET, z=0.5))


_COUNTS = f"SELECT service, {_HOUR} AS m, count(*) AS cnt FROM spans GROUP BY ALL"
_SURGE = f"""(SELECT service, count(*) AS buckets, max(cnt) FILTER (back = 1) AS last,
    avg(cnt) FILTER (back > 1) AS baseline,
    CAST(max(cnt) FILTER (back = 1) AS double) / avg(cnt) FILTER (back > 1) AS ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY m DESC) AS back
        FROM ({_COUNTS})) GROUP BY 1)"""
_LATENCY = (f"(SELECT service, {_P99} AS p99_ms, avg(duration_ns) / 1e6 AS avg_ms, "
            "count(*) AS total FROM spans GROUP BY 1)")
_WATERFALL = (f"(SELECT service, p99_ms, count(*) OVER () AS services, p99_ms / sum(p99_ms) "
              f"OVER () AS share FROM {_LATENCY})")
_DROPLET = f"(SELECT *, p99_ms / avg_ms AS ratio FROM {_LATENCY})"
_WAVE = f"""(SELECT service, count(*) AS buckets, avg((cnt - mean) * (later - mean)) AS cov,
    avg((cnt - mean) * (cnt - mean)) AS var,
    avg((cnt - mean) * (later - mean)) / avg((cnt - mean) * (cnt - mean)) AS autocorr
  FROM (SELECT *, avg(cnt) OVER (PARTITION BY service) AS mean,
          lead(cnt, 5) OVER (PARTITION BY service ORDER BY m) AS later FROM ({_COUNTS}))
  GROUP BY 1)"""


@query("surge", f"SELECT service, buckets, last, round(baseline, 6) AS baseline, "
       f"round(ratio, 6) AS ratio FROM {_SURGE}", ("spans",))
def surge(spark, sf):
    return rounded(P.surge_scores(V.spans(spark, sf), V.START, V.END, BUCKET), "baseline", "ratio")


@query("waterfall", f"SELECT service, round(p99_ms, 6) AS p99_ms, services, "
       f"round(share, 9) AS share FROM {_WATERFALL}", ("spans",))
def waterfall(spark, sf):
    return rounded(rounded(P.waterfall_scores(V.spans(spark, sf), V.START, V.END), "p99_ms"),
                   "share", digits=9)


@query("p99_share", f"SELECT service, round(share * 100, 6) AS percent FROM {_WATERFALL}",
       ("spans",))
def p99_share(spark, sf):
    scores = P.waterfall_scores(V.spans(spark, sf), V.START, V.END)
    return scores.select("service", F.round(F.col("share") * 100, 6).alias("percent"))


@query("droplet", f"SELECT service, total, round(p99_ms, 6) AS p99_ms, round(avg_ms, 6) AS avg_ms, "
       f"round(ratio, 6) AS ratio FROM {_DROPLET}", ("spans",))
def droplet(spark, sf):
    return rounded(P.droplet_scores(V.spans(spark, sf), V.START, V.END), "p99_ms", "avg_ms",
                   "ratio")


@query("wave", f"SELECT service, buckets, round(cov, 6) AS cov, round(var, 6) AS var, "
       f"round(autocorr, 6) AS autocorr FROM {_WAVE}", ("spans",))
def wave(spark, sf):
    return rounded(P.wave_scores(V.spans(spark, sf), V.START, V.END, BUCKET), "cov", "var",
                   "autocorr")


@query("lag5_autocorr", f"SELECT service, buckets, round(autocorr, 6) AS autocorr FROM {_WAVE}",
       ("spans",))
def lag5_autocorr(spark, sf):
    scores = P.wave_scores(V.spans(spark, sf), V.START, V.END, BUCKET)
    return rounded(scores.select("service", "buckets", "autocorr"), "autocorr")


# Endpoints in the data: the range ends inside a burst of svc-4, so that surge has a hit.
_PATTERNS = f"""SELECT 'surge' AS pattern, service, least(1, (ratio - 3) / 7 * 0.3 + 0.7) AS c
  FROM {_SURGE} WHERE buckets >= 10 AND baseline > 0 AND ratio >= 3 UNION ALL
  SELECT 'waterfall', service, least(1, (share - 0.7) / 0.3 * 0.5 + 0.5) FROM {_WATERFALL}
  WHERE services >= 2 AND share >= 0.7 UNION ALL
  SELECT 'droplet', service, least(1, (ratio - 10) / 90 * 0.5 + 0.5) FROM {_DROPLET}
  WHERE avg_ms > 0 AND total >= 100 AND ratio >= 10 UNION ALL
  SELECT 'wave', service, least(1, (autocorr - 0.6) / 0.4 * 0.5 + 0.5) FROM {_WAVE}
  WHERE buckets >= 25 AND var > 0 AND autocorr >= 0.6"""

# A copy of the spans in which svc-0 is slow and heavy-tailed and svc-1 comes in five-hour waves,
# so that the thresholds are crossed in both directions.
_SHAPED = """shaped AS (SELECT * REPLACE (
    CASE WHEN service = 'svc-0' AND kind = 0 AND status_code = 2 THEN duration_ns * 4000
         ELSE duration_ns END AS duration_ns,
    CASE WHEN extract(hour FROM start_time) % 5 = 0 THEN 'svc-1' ELSE service END AS service)
  FROM spans)"""


def shaped_spans(spark, sf) -> DataFrame:
    heavy = (F.col("service") == "svc-0") & (F.col("kind") == 0) & (F.col("status_code") == 2)
    waved = F.hour("start_time") % 5 == 0
    return V.spans(spark, sf).withColumns({
        "duration_ns": F.when(heavy, F.col("duration_ns") * 4000).otherwise(F.col("duration_ns")),
        "service": F.when(waved, "svc-1").otherwise(F.col("service"))})


def _patterns_sql(text: str) -> str:
    return f"WITH {_SHAPED}, found AS ({_PATTERNS.replace('FROM spans', 'FROM shaped')}) {text}"


@query("detect_patterns", _patterns_sql("SELECT pattern, service, round(c, 6) AS confidence "
                                        "FROM found"), ("spans",))
def detect_patterns(spark, sf):
    found = P.detect_patterns(shaped_spans(spark, sf), V.START, V.END, BUCKET)
    return rounded(found.drop("description"), "confidence")


@query("patterns_ranked", _patterns_sql("SELECT pattern, service, row_number() OVER (ORDER BY c "
                                        "DESC, pattern, service) AS place FROM found"), ("spans",))
def patterns_ranked(spark, sf):
    from pyspark.sql import Window as W

    found = P.detect_patterns(shaped_spans(spark, sf), V.START, V.END, BUCKET)
    # A handful of patterns per service is left at this point.
    place = F.row_number().over(W.orderBy(F.desc("confidence"), "pattern", "service"))
    return found.select("pattern", "service", place.cast("long").alias("place"))


_BAND = "CASE WHEN {v} > {c} THEN 'critical' WHEN {v} > {w} THEN 'warning' ELSE 'info' END"


@query("error_findings", f"""SELECT {_BAND.format(v='error_rate', c=0.1, w=0.01)} AS severity,
    printf('[%s] 서비스 에러율 %.2f%%', service, error_rate * 100) AS message, service,
    'error_rate' AS metric, round(error_rate, 9) AS value
  FROM (SELECT service, {_RATE} AS error_rate FROM spans GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 5) WHERE error_rate > 0""", ("spans",))
def error_findings(spark, sf):
    return rounded(G.error_findings(V.spans(spark, sf), V.START, V.END), "value", digits=9)


@query("latency_findings", f"""SELECT {_BAND.format(v='p99_ms', c=5000, w=1000)} AS severity,
    printf('[%s] p99 레이턴시 %.1fms', service, p99_ms) AS message, service,
    'p99_latency_ms' AS metric, round(p99_ms, 6) AS value
  FROM (SELECT service, {_P99} AS p99_ms FROM spans GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""",
       ("spans",))
def latency_findings(spark, sf):
    return rounded(G.latency_findings(V.spans(spark, sf), V.START, V.END), "value")


@query("traffic_findings", """SELECT 'info' AS severity,
    printf('[%s] 분석 기간 총 요청 %d건', service, cnt) AS message, service,
    'request_count' AS metric, CAST(cnt AS double) AS value
  FROM (SELECT service, count(*) AS cnt FROM spans GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
       ("spans",))
def traffic_findings(spark, sf):
    return G.traffic_findings(V.spans(spark, sf), V.START, V.END)


@query("overview_findings", f"""SELECT CASE WHEN error_rate > 0.05 THEN 'warning' ELSE 'info' END
    AS severity, printf('[%s] 총 %d건, 에러율 %.2f%%', service, total, error_rate * 100) AS message,
    service, 'error_rate' AS metric, round(error_rate, 9) AS value
  FROM ({_OVERVIEW.format(limit=10)})""", ("spans",))
def overview_findings(spark, sf):
    return rounded(G.overview_findings(V.spans(spark, sf), V.START, V.END), "value", digits=9)


@query("general_findings", f"""SELECT 'warning' AS severity,
    printf('[%s] 에러율 %.2f%%', service, error_rate * 100) AS message, service,
    'error_rate' AS metric, round(error_rate, 9) AS value
  FROM ({_OVERVIEW.format(limit=5)}) WHERE error_rate > 0.01""", ("spans",))
def general_findings(spark, sf):
    return rounded(G.general_findings(V.spans(spark, sf), V.START, V.END), "value", digits=9)
