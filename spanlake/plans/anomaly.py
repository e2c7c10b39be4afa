"""Z-score of the latest bucket against the buckets before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.codes import is_error
from ..functions.ranks import exact_quantiles
from ..functions.times import bucket_start, in_range, instant, seconds_before

# Longest window, fewest buckets, reporting score.
MAX_WINDOW_MINUTES = 1440
MIN_BUCKETS = 5
REPORT_SCORE = 3.0


def minute_health(spans: DataFrame, start=None, end=None, bucket: str = "1 minute") -> DataFrame:
    """Error rate, p99 (ms) and request count per tenant and bucket."""
    rows = in_range(spans, "start_time", start, end).select(
        "tenant_id", bucket_start(F.col("start_time"), bucket).alias("minute"), "duration_ns",
        F.when(is_error(), 1).otherwise(0).alias("_error"))
    stats = exact_quantiles(rows, "duration_ns", {"p99": 0.99}, ["tenant_id", "minute"],
                            {"_errors": F.col("_error")}, count="total")
    return stats.select("tenant_id", "minute",
                        (F.col("_errors") / F.col("total")).alias("error_rate"),
                        (F.col("p99") / 1e6).alias("p99_ms"), "total")


def anomaly_scores(spans: DataFrame, as_of, window_minutes: int = 60,
                   bucket: str = "1 minute") -> DataFrame:
    """Score of the last bucket per tenant and metric; nothing with fewer than 5 buckets.

    score = |current - mean| / population stddev of the earlier buckets, 0 when they are
    constant.  The windows run over at most 1440 buckets per tenant.
    """
    window = min(int(window_minutes), MAX_WINDOW_MINUTES)
    health = minute_health(spans, seconds_before(as_of, window * 60), instant(as_of), bucket)
    tenant = W.partitionBy("tenant_id")
    ranked = (
        health.withColumn("_back", F.row_number().over(tenant.orderBy(F.desc("minute"))))
        .withColumn("_buckets", F.count(F.lit(1)).over(tenant))
        .where(F.col("_buckets") >= MIN_BUCKETS)
        .select("tenant_id", "minute", "_back", F.explode(F.create_map(
            F.lit("error_rate"), F.col("error_rate"),
            F.lit("p99_latency_ms"), F.col("p99_ms"))).alias("metric", "_v")))
    past = F.when(F.col("_back") > 1, F.col("_v"))
    scored = ranked.groupBy("tenant_id", "metric").agg(
        F.max(F.when(F.col("_back") == 1, F.col("_v"))).alias("current"),
        F.avg(past).alias("baseline"), F.stddev_pop(past).alias("_sd"),
        F.max("minute").alias("minute"))
    score = F.when(F.col("_sd") > 0,
                   F.abs(F.col("current") - F.col("baseline")) / F.col("_sd")).otherwise(0.0)
    return scored.select(F.concat(F.lit("tenant:"), F.col("tenant_id")).alias("service"),
                         "metric", score.alias("score"), "baseline", "current", "minute")


def detect_anomalies(spans: DataFrame, as_of, window_minutes: int = 60,
                     bucket: str = "1 minute", z: float = REPORT_SCORE) -> DataFrame:
    """Scores above ``z``."""
    return anomaly_scores(spans, as_of, window_minutes, bucket).where(F.col("score") > z)


def anomaly_band(score: Column) -> Column:
    """Display band of a score."""
    return F.when(score > 3, "red").when(score > 2, "amber").otherwise("blue")
