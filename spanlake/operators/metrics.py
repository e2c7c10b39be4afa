"""Bucketed time-series queries and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import series_key
from ..functions.times import bucket_ms, in_range
from .xview import service_env

LABELS = ("service", "env")


def _aggregate(agg: str, step: int) -> Column:
    """avg, sum, max, min or rate (sum per second); anything else is avg."""
    return {
        "sum": F.sum("value"), "max": F.max("value"), "min": F.min("value"),
        "rate": F.sum("value") / F.lit(float(step)),
    }.get(agg.lower(), F.avg("value"))


def query_range(metrics: DataFrame, name: str, start=None, end=None, step: int = 60,
                agg: str = "avg", service: str | None = None, env: str | None = None,
                group_by: Sequence[str] = ()) -> DataFrame:
    """One row (labels..., t, v) per series and step, sorted by labels and time.

    ``group_by`` takes service and env; other keys are ignored.
    """
    labels = [k for k in LABELS if k in group_by]
    step = max(int(step), 1)
    rows = service_env(in_range(metrics, "timestamp", start, end), service, env)
    return (
        rows.where(F.col("name") == name)
        .groupBy(*labels, bucket_ms(F.col("timestamp"), step).alias("t"))
        .agg(_aggregate(agg, step).alias("v"))
        .orderBy(*labels, "t")
    )


def with_series_key(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add the text key of each series, such as ``service=a,env=b``."""
    return series.withColumn("series", series_key(*labels))


def as_series(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label set with its time-ordered (t, v) points."""
    points = F.sort_array(F.collect_list(F.struct("t", "v")))
    return series.groupBy(*labels).agg(points.alias("data")).orderBy(*labels)


def list_metrics(metrics: DataFrame, limit: int = 1000) -> DataFrame:
    """Distinct (name, service), by name."""
    return metrics.select("name", "service").distinct().orderBy("name", "service").limit(limit)


def list_services(spans: DataFrame, metrics: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct (service, env) seen in spans or metrics, by service.

    Each side is made distinct first, so only the small sets meet in the union.
    """
    sides = [df.select("service", "env").distinct() for df in (spans, metrics)]
    return sides[0].union(sides[1]).distinct().orderBy("service", "env").limit(limit)


def metric_sources(*sources: DataFrame) -> DataFrame:
    """Rule-derived and ingested metric rows as one table."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
