"""Minute statistics as spans arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codes import is_error
from ..functions.ranks import sorted_quantile
from ..operators.rollup import QUANTILES, SKETCH_K, with_estimates


def _windowed(spans: DataFrame, width: str, delay: str):
    return spans.withWatermark("start_time", delay).groupBy(
        F.window("start_time", width).alias("_w"), "tenant_id", "service", "env")


def stream_span_stats(spans: DataFrame, width: str = "1 minute", delay: str = "5 minutes",
                      exact: bool = False) -> DataFrame:
    """Minute statistics, emitted once the watermark has passed the minute.

    State per group is counts and one quantile sketch of bounded size; the sketch is kept in
    the output, so minutes merge into hours later.  ``exact=True`` keeps every value of a
    minute in state instead, for streams with modest minutes.
    """
    errors = F.sum(F.when(is_error(), 1).otherwise(0)).alias("errors")
    count = F.count(F.lit(1)).alias("requests")
    total = F.sum(F.col("duration_ns").cast("double")).alias("total_ns")
    grouped = _windowed(spans, width, delay)
    minute = F.col("_w.start").alias("minute")
    if not exact:
        parts = grouped.agg(count, errors, total, F.kll_sketch_agg_bigint(
            "duration_ns", F.lit(SKETCH_K)).alias("sketch"))
        return with_estimates(parts.select("tenant_id", "service", "env", minute, "requests",
                                           "errors", "total_ns", "sketch"))
    # Sorted values and the interpolation of the batch form, so that both agree to the last digit.
    held = F.sort_array(F.collect_list("duration_ns")).alias("_values")
    minutes = grouped.agg(count, errors, total, held).select(
        "tenant_id", "service", "env", minute, "requests", "errors",
        (F.col("total_ns") / F.col("requests")).alias("avg_ns"), "_values")
    return minutes.select("*", *[F.expr(sorted_quantile("_values", q, n))
                                 for n, q in QUANTILES.items()]).drop("_values")
