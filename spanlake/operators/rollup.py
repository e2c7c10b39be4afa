"""Per-minute span statistics and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codes import is_error
from ..functions.ranks import exact_quantiles
from ..functions.times import bucket_start
from .xview import QUANTILES

KEYS = ["tenant_id", "service", "env", "minute"]
#: Size parameter of the mergeable sketch: rank error about 0.5 %.
SKETCH_K = 800


def span_stats(spans: DataFrame, width: str = "1 minute") -> DataFrame:
    """Exact count, errors, p50/p95/p99 and mean duration per tenant, service, env, bucket."""
    rows = spans.select("tenant_id", "service", "env", "duration_ns",
                        bucket_start(F.col("start_time"), width).alias("minute"),
                        F.when(is_error(), 1).otherwise(0).alias("_error"))
    stats = exact_quantiles(rows, "duration_ns", QUANTILES, KEYS, split=True, count="requests", sums={
        "errors": F.col("_error"), "_total": F.col("duration_ns").cast("double")})
    return stats.select(*KEYS, "requests", "errors", *QUANTILES,
                        (F.col("_total") / F.col("requests")).alias("avg_ns"))


def span_sketches(spans: DataFrame, width: str = "1 minute") -> DataFrame:
    """Mergeable partial statistics: counts, sum and a bounded quantile sketch per bucket."""
    return (
        spans.groupBy("tenant_id", "service", "env",
                      bucket_start(F.col("start_time"), width).alias("minute"))
        .agg(F.count(F.lit(1)).alias("requests"),
             F.sum(F.when(is_error(), 1).otherwise(0)).alias("errors"),
             F.sum(F.col("duration_ns").cast("double")).alias("total_ns"),
             F.kll_sketch_agg_bigint("duration_ns", F.lit(SKETCH_K)).alias("sketch"))
    )


def merge_span_stats(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Combine partial rows of the same key (several inserts, or minutes into hours).

    Counts add, the mean is weighted by count, and quantiles come from merged sketches: adding
    up quantiles would be wrong.
    """
    keys = KEYS if keys is None else keys
    merged = parts.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.sum("total_ns").alias("total_ns"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return with_estimates(merged, keys)


def with_estimates(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and estimated quantiles of partial rows; keeps the sketch for later merges."""
    keys = KEYS if keys is None else keys
    estimates = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(name)
                 for name, q in QUANTILES.items()]
    return parts.select(*keys, "requests", "errors", *estimates,
                        (F.col("total_ns") / F.col("requests")).alias("avg_ns"), "total_ns",
                        "sketch")
