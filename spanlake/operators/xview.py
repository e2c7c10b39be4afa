"""Response-time scatter: points, statistics, selection and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import is_error, percent
from ..functions.ranks import exact_quantiles
from ..functions.times import in_range
from ..functions.topk import first_by_time, top_k

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
DEFAULT_POINTS = 500_000


def service_env(df: DataFrame, service: str | None = None, env: str | None = None) -> DataFrame:
    """Optional equality on service and env; an absent value means all."""
    if service is not None:
        df = df.where(F.col("service") == service)
    if env is not None:
        df = df.where(F.col("env") == env)
    return df


def _selected(spans, start, end, service, env) -> DataFrame:
    return service_env(in_range(spans, "start_time", start, end), service, env)


def as_points(spans: DataFrame) -> DataFrame:
    """Points (t ms, d ns, s 1 for errors, tr trace id)."""
    return spans.select(
        F.unix_millis("start_time").alias("t"), F.col("duration_ns").alias("d"),
        F.when(is_error(), 1).otherwise(0).alias("s"), F.col("trace_id").alias("tr"))


def xview_points(spans: DataFrame, start=None, end=None, service: str | None = None,
                 env: str | None = None, limit: int = DEFAULT_POINTS) -> DataFrame:
    """Oldest ``limit`` points of the range, oldest first."""
    rows = _selected(spans, start, end, service, env).select(
        "start_time", "duration_ns", "status_code", "trace_id", "span_id")
    return as_points(first_by_time(rows, "start_time", limit, ["trace_id", "span_id"]))


def xview_stats(spans: DataFrame, start=None, end=None, service: str | None = None,
                env: str | None = None) -> DataFrame:
    """One row: total, errors and p50/p95/p99 of duration (whole ns); zeros when empty."""
    rows = _selected(spans, start, end, service, env)
    errors = F.when(is_error(), 1).otherwise(0)
    stats = exact_quantiles(rows, "duration_ns", QUANTILES, sums={"errors": errors},
                            count="total")
    return stats.selectExpr("total", "CAST(coalesce(errors, 0) AS BIGINT) AS errors",
                            *[f"coalesce(CAST({q} AS BIGINT), 0L) AS {q}" for q in QUANTILES])


def error_percent(stats: DataFrame) -> DataFrame:
    """Error percentage of a statistics row, flagged above 1 %."""
    share = percent(F.col("errors"), F.col("total"))
    return stats.select("total", "errors", share.alias("error_percent"),
                        (share > 1).alias("flagged"))


def select_rect(points: DataFrame, t0: int, t1: int, d0: int, d1: int) -> DataFrame:
    """Points inside a closed time/duration rectangle.

    The scatter's log1p axis is monotone, so raw bounds select the same points.
    """
    return points.where(F.col("t").between(t0, t1) & F.col("d").between(d0, d1))


def selected_transactions(rows: DataFrame, picked: DataFrame, on: str | list[str]) -> DataFrame:
    """Full rows whose id is among the picked ones."""
    return rows.join(picked, on, "left_semi")


def transactions_table(selected: DataFrame, limit: int = 100) -> DataFrame:
    """First ``limit`` selected points with a duration band and the overflow count.

    The overflow is a scalar subquery: counting combines map-side and moves no rows.
    """
    total = selected.agg(F.count(F.lit(1)).alias("n")).scalar()
    ms = F.col("d") / F.lit(1e6)
    band = F.when(ms > 1000, "slow").when(ms > 300, "medium").otherwise("fast")
    return (
        top_k(selected, [F.col("t"), F.col("tr"), F.col("d")], limit)
        .withColumn("band", band)
        .withColumn("overflow", F.greatest(total - F.lit(limit), F.lit(0)))
    )


def _pad(low: Column, high: Column) -> Column:
    return (high - low) * F.lit(0.02)


def normalize(points: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points with ``nx`` (linear) and ``ny`` (log1p) scaled to [0, 1].

    The data's extent gets 2 % padding and the lower duration bound stays at or above 0; a
    given range fixes x without padding.  The extent is one row, read as scalar subqueries.
    """
    extent = points.agg(F.min("t").alias("t0"), F.max("t").alias("t1"),
                        F.min("d").alias("d0"), F.max("d").alias("d1"))
    t_pad, d_pad = _pad(F.col("t0"), F.col("t1")), _pad(F.col("d0"), F.col("d1"))
    fixed_range = start is not None and end is not None
    bounds = extent.select(F.struct(
        (F.lit(float(start)) if fixed_range else F.col("t0") - t_pad).alias("x0"),
        (F.lit(float(end)) if fixed_range else F.col("t1") + t_pad).alias("x1"),
        F.log1p(F.greatest(F.lit(0.0), F.col("d0") - d_pad)).alias("y0"),
        F.log1p(F.col("d1") + d_pad).alias("y1"),
    ).alias("b")).scalar()
    return (
        points.withColumn("_b", bounds)
        .withColumn("nx", F.try_divide(F.col("t") - F.col("_b.x0"),
                                       F.col("_b.x1") - F.col("_b.x0")))
        .withColumn("ny", F.try_divide(F.log1p("d") - F.col("_b.y0"),
                                       F.col("_b.y1") - F.col("_b.y0")))
        .drop("_b")
    )
