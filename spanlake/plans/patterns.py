"""Traffic patterns: surge, waterfall, droplet and wave.

``*_scores`` give every candidate with its measures; ``detect_*`` apply the thresholds.  All
windows run over aggregated rows: services, or one service's time buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.times import bucket_start, in_range
from .findings import latencies

# Thresholds of the four patterns.
SURGE_BUCKETS, SURGE_RATIO = 10, 3.0
WATERFALL_SERVICES, WATERFALL_SHARE = 2, 0.70
DROPLET_ROWS, DROPLET_RATIO = 100, 10.0
WAVE_BUCKETS, WAVE_LAG, WAVE_CORRELATION = 25, 5, 0.6

# Description formats.
DESCRIPTIONS = {
    "surge": "[%s] 서비스에 요청 급증 발생: 최근 1분 %d건 (직전 평균의 %.1f배)",
    "waterfall": "[%s] 서비스가 전체 p99 레이턴시의 %.0f%%를 차지하는 Waterfall 패턴 감지 (p99=%.1fms)",
    "droplet": "[%s] 극단적 이상 거래 감지 (Droplet): p99=%.1fms, avg=%.1fms, 비율=%.1fx",
    "wave": "[%s] 5분 주기 레이턴시 스파이크 패턴 감지 (Wave): autocorr=%.2f",
}


def _confidence(measure: Column, floor: float, span: float, base: float) -> Column:
    """``base`` at the threshold, rising linearly to 1 at floor + span."""
    return F.least(F.lit(1.0), (measure - F.lit(floor)) / F.lit(span) * F.lit(1 - base)
                   + F.lit(base))


def minute_counts(spans: DataFrame, start=None, end=None, bucket: str = "1 minute") -> DataFrame:
    """Requests per service and bucket; silent buckets are absent."""
    return (
        in_range(spans, "start_time", start, end)
        .groupBy("service", bucket_start(F.col("start_time"), bucket).alias("minute"))
        .agg(F.count(F.lit(1)).alias("cnt")))


def surge_scores(spans: DataFrame, start=None, end=None, bucket: str = "1 minute") -> DataFrame:
    """Each service's last bucket against the mean of its earlier ones."""
    return _surge(minute_counts(spans, start, end, bucket))


def _surge(counts: DataFrame) -> DataFrame:
    back = F.row_number().over(W.partitionBy("service").orderBy(F.desc("minute")))
    past = F.when(F.col("_back") > 1, F.col("cnt"))
    scored = counts.withColumn("_back", back).groupBy("service").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.max(F.when(F.col("_back") == 1, F.col("cnt"))).alias("last"),
        F.avg(past).alias("baseline"))
    return scored.withColumn("ratio", F.try_divide(F.col("last").cast("double"),
                                                   F.col("baseline")))


def _pattern(df: DataFrame, name: str, confidence: Column, *values: Column) -> DataFrame:
    text = F.format_string(DESCRIPTIONS[name], F.col("service"), *values)
    return df.select(F.lit(name).alias("pattern"), "service", confidence.alias("confidence"),
                     text.alias("description"))


def detect_surge(scores: DataFrame) -> DataFrame:
    hits = scores.where((F.col("buckets") >= SURGE_BUCKETS) & (F.col("baseline") > 0)
                        & (F.col("ratio") >= SURGE_RATIO))
    return _pattern(hits, "surge", _confidence(F.col("ratio"), SURGE_RATIO, 7.0, 0.7),
                    F.col("last"), F.col("ratio"))


def waterfall_scores(spans: DataFrame, start=None, end=None) -> DataFrame:
    """Each service's share of the sum of all services' p99."""
    return _waterfall(latencies(spans, start, end))


def _waterfall(latency: DataFrame) -> DataFrame:
    # One row per service reaches this window.
    every = W.partitionBy(F.lit(1))
    return (
        latency.select("service", "p99_ms")
        .withColumn("services", F.count(F.lit(1)).over(every))
        .withColumn("share", F.try_divide(F.col("p99_ms"), F.sum("p99_ms").over(every))))


def detect_waterfall(scores: DataFrame) -> DataFrame:
    hits = scores.where((F.col("services") >= WATERFALL_SERVICES)
                        & (F.col("share") >= WATERFALL_SHARE))
    return _pattern(hits, "waterfall", _confidence(F.col("share"), WATERFALL_SHARE, 0.3, 0.5),
                    F.col("share") * 100, F.col("p99_ms"))


def droplet_scores(spans: DataFrame, start=None, end=None) -> DataFrame:
    """Each service's p99 over its mean."""
    return _droplet(latencies(spans, start, end))


def _droplet(latency: DataFrame) -> DataFrame:
    return latency.withColumn("ratio", F.try_divide(F.col("p99_ms"), F.col("avg_ms")))


def detect_droplet(scores: DataFrame) -> DataFrame:
    hits = scores.where((F.col("avg_ms") > 0) & (F.col("total") >= DROPLET_ROWS)
                        & (F.col("ratio") >= DROPLET_RATIO))
    return _pattern(hits, "droplet", _confidence(F.col("ratio"), DROPLET_RATIO, 90.0, 0.5),
                    F.col("p99_ms"), F.col("avg_ms"), F.col("ratio"))


def wave_scores(spans: DataFrame, start=None, end=None, bucket: str = "1 minute") -> DataFrame:
    """Lag-5 autocorrelation of each service's bucket counts, paired by position."""
    return _wave(minute_counts(spans, start, end, bucket))


def _wave(counts: DataFrame) -> DataFrame:
    whole = W.partitionBy("service")
    off = F.col("cnt") - F.col("_mean")
    paired = (
        counts.withColumn("_mean", F.avg("cnt").over(whole))
        .withColumn("_later", F.lead("cnt", WAVE_LAG).over(whole.orderBy("minute"))))
    scored = paired.groupBy("service").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.avg(off * (F.col("_later") - F.col("_mean"))).alias("cov"),
        F.avg(off * off).alias("var"))
    return scored.withColumn("autocorr", F.try_divide(F.col("cov"), F.col("var")))


def detect_wave(scores: DataFrame) -> DataFrame:
    hits = scores.where((F.col("buckets") >= WAVE_BUCKETS) & (F.col("var") > 0)
                        & (F.col("autocorr") >= WAVE_CORRELATION))
    return _pattern(hits, "wave", _confidence(F.col("autocorr"), WAVE_CORRELATION, 0.4, 0.5),
                    F.col("autocorr"))


def detect_patterns(spans: DataFrame, start=None, end=None,
                    bucket: str = "1 minute") -> DataFrame:
    """All patterns, most confident first.

    Surge and wave share one count aggregate, waterfall and droplet one latency aggregate;
    their exchanges are reused inside the single plan.
    """
    counts = minute_counts(spans, start, end, bucket)
    latency = latencies(spans, start, end)
    found = [detect_surge(_surge(counts)), detect_waterfall(_waterfall(latency)),
             detect_droplet(_droplet(latency)), detect_wave(_wave(counts))]
    every = reduce(DataFrame.unionByName, found)
    return every.orderBy(F.desc("confidence"), "pattern", "service")
