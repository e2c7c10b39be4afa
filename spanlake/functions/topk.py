"""First-k selection that never funnels every partition's first k into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import select_ranks

#: Lanes of the two-level top-k; the last task sees at most LANES * k rows.
LANES = 256
#: Above this k the cut-off time is found first (see :func:`oldest`).
LANE_LIMIT = 10_000
#: Time bands of a cut-off search.
TIME_BANDS = 1 << 14


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows by ``order`` (which must be total for repeatable results).

    Each map task keeps k rows, lanes of tasks merge to k rows each, the last step merges
    the lanes.  One scan, whatever the number of input partitions.
    """
    lane = W.partitionBy("_lane").orderBy(*order)
    merged = (
        df.withColumn("_lane", F.spark_partition_id() % LANES)
        .withColumn("_place", F.row_number().over(lane))
        .where(F.col("_place") <= k)
        .drop("_lane", "_place")
    )
    return merged.orderBy(*order).limit(k)


def time_cutoff(df: DataFrame, ts: str, k: int, newest: bool = False):
    """Exact time (epoch µs) of the k-th oldest or newest of more than k rows.

    Runs two counts over the time column.  Fewer than k rows lie strictly before the cut-off.
    """
    sign = "-" if newest else ""
    # Linear bands of a day / TIME_BANDS: 5.3 s, so at most 5.3 million distinct values each.
    found = select_ranks(
        df, F.expr(f"{sign}unix_micros(`{ts}`)"), f"array({int(k) - 1}L)",
        band=f"floor(_value / {86_400_000_000 // TIME_BANDS})").first()
    return -found._value if newest else found._value


def first_by_time(df: DataFrame, ts: str, k: int, tie: list[str],
                  newest: bool = False) -> DataFrame:
    """The k oldest (or newest) rows by ``ts``, ties broken by the ``tie`` columns.

    A small k merges in lanes, lazily.  A large k first finds the exact cut-off time; rows past
    it are filtered in the scan, so no more than k rows plus ties reach the sort.
    """
    order = [F.col(ts).desc() if newest else F.col(ts).asc(), *[F.col(c) for c in tie]]
    if k <= LANE_LIMIT:
        return top_k(df, order, k)
    if df.count() > k:
        cut = time_cutoff(df, ts, k, newest)
        edge = F.timestamp_micros(F.lit(cut))
        df = df.where(F.col(ts) >= edge if newest else F.col(ts) <= edge)
    return df.orderBy(*order).limit(k)
