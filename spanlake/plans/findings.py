"""Ranked per-service findings of a time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import is_error
from ..functions.ranks import exact_quantiles
from ..functions.text import intent
from ..functions.times import in_range

# Severity bands of the findings.
ERROR_BANDS = {"critical": 0.1, "warning": 0.01}
LATENCY_BANDS_MS = {"critical": 5000.0, "warning": 1000.0}
OVERVIEW_WARNING = 0.05

# Message formats.
MESSAGES = {
    "error": "[%s] 서비스 에러율 %.2f%%",
    "latency": "[%s] p99 레이턴시 %.1fms",
    "traffic": "[%s] 분석 기간 총 요청 %d건",
    "overview": "[%s] 총 %d건, 에러율 %.2f%%",
    "general": "[%s] 에러율 %.2f%%",
}


def _rows(spans: DataFrame, start, end, service: str | None = None) -> DataFrame:
    rows = in_range(spans, "start_time", start, end)
    return rows if service is None else rows.where(F.col("service") == service)


def service_errors(spans: DataFrame, start=None, end=None,
                   service: str | None = None) -> DataFrame:
    """Error rate and request count of every service."""
    return _rows(spans, start, end, service).groupBy("service").agg(
        (F.count_if(is_error()) / F.count(F.lit(1))).alias("error_rate"),
        F.count(F.lit(1)).alias("total"))


def service_error_rate(spans: DataFrame, start=None, end=None, service: str | None = None,
                       limit: int = 5) -> DataFrame:
    """Services by error rate."""
    rates = service_errors(spans, start, end, service)
    return rates.orderBy(F.desc("error_rate"), "service").limit(limit)


def service_overview(spans: DataFrame, start=None, end=None, service: str | None = None,
                     limit: int = 10) -> DataFrame:
    """Services by request count, with error rate."""
    rates = service_errors(spans, start, end, service)
    return rates.orderBy(F.desc("total"), "service").limit(limit)


def latencies(spans: DataFrame, start=None, end=None, service: str | None = None) -> DataFrame:
    """p99 and mean duration (ms) and request count of every service."""
    stats = exact_quantiles(_rows(spans, start, end, service), "duration_ns", {"p99": 0.99},
                            ["service"], {"_ns": F.col("duration_ns").cast("double")},
                            count="total")
    return stats.select("service", (F.col("p99") / 1e6).alias("p99_ms"),
                        (F.col("_ns") / F.col("total") / 1e6).alias("avg_ms"), "total")


def service_latency(spans: DataFrame, start=None, end=None, service: str | None = None,
                    limit: int = 5) -> DataFrame:
    """Services by p99."""
    slow = latencies(spans, start, end, service).drop("total")
    return slow.orderBy(F.desc("p99_ms"), "service").limit(limit)


def service_traffic(spans: DataFrame, start=None, end=None, limit: int = 10) -> DataFrame:
    """Services by request count."""
    counts = _rows(spans, start, end).groupBy("service").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "service").limit(limit)


def system_summary(spans: DataFrame, start=None, end=None) -> DataFrame:
    """Requests over the five busiest services and whether any has errors above 1 %."""
    return service_overview(spans, start, end, limit=5).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.bool_or(F.col("error_rate") > 0.01), F.lit(False)).alias("has_errors"),
        F.count(F.lit(1)).alias("services"))


def _banded(value: Column, bands: dict[str, float]) -> Column:
    out = None
    for name, floor in bands.items():
        out = F.when(value > floor, name) if out is None else out.when(value > floor, name)
    return out.otherwise("info")


def _finding(df: DataFrame, severity: Column, message: Column, metric: str,
             value: Column) -> DataFrame:
    return df.select(severity.alias("severity"), message.alias("message"), "service",
                     F.lit(metric).alias("metric"), value.cast("double").alias("value"))


def _message(kind: str, *values: Column) -> Column:
    return F.format_string(MESSAGES[kind], F.col("service"), *values)


def error_findings(spans: DataFrame, start=None, end=None,
                   service: str | None = None) -> DataFrame:
    top = service_error_rate(spans, start, end, service).where(F.col("error_rate") > 0)
    return _finding(top, _banded(F.col("error_rate"), ERROR_BANDS),
                    _message("error", F.col("error_rate") * 100),
                    "error_rate", F.col("error_rate"))


def latency_findings(spans: DataFrame, start=None, end=None,
                     service: str | None = None) -> DataFrame:
    top = service_latency(spans, start, end, service)
    return _finding(top, _banded(F.col("p99_ms"), LATENCY_BANDS_MS),
                    _message("latency", F.col("p99_ms")),
                    "p99_latency_ms", F.col("p99_ms"))


def traffic_findings(spans: DataFrame, start=None, end=None) -> DataFrame:
    top = service_traffic(spans, start, end)
    return _finding(top, F.lit("info"), _message("traffic", F.col("cnt")), "request_count", F.col("cnt"))


def overview_findings(spans: DataFrame, start=None, end=None,
                      service: str | None = None) -> DataFrame:
    top = service_overview(spans, start, end, service)
    severity = F.when(F.col("error_rate") > OVERVIEW_WARNING, "warning").otherwise("info")
    return _finding(top, severity,
                    _message("overview", F.col("total"), F.col("error_rate") * 100),
                    "error_rate", F.col("error_rate"))


def general_findings(spans: DataFrame, start=None, end=None) -> DataFrame:
    top = service_overview(spans, start, end, limit=5).where(F.col("error_rate") > 0.01)
    return _finding(top, F.lit("warning"), _message("general", F.col("error_rate") * 100),
                    "error_rate", F.col("error_rate"))


def tag_intent(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages with the intent their keywords name."""
    return messages.withColumn("intent", intent(F.col(column)))
