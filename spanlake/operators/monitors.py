"""Monitor evaluation: all monitors and ticks together, by joins and aggregates.

A monitor is (tenant_id, monitor_id, name, kind, service, aggregation, window_secs, op,
threshold, severity, enabled, interval_secs).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import LOG_ERROR_FLOOR, is_error, violated
from ..functions.ranks import DRIVER_ROWS, between, log_band, position, with_known_size
from ..functions.times import in_range, instant
from ..session import cut_lineage

#: Seconds between two looks at the monitor list.
POLL_SECONDS = 10

#: Duration bands per e-fold in p99 windows: about 0.4 % wide, so that a service has at most a few
#: thousand of them in a second, whatever its number of spans.
TAIL_BANDS = 256


def _with_schedule(monitors: DataFrame, start, end, poll: int) -> DataFrame:
    """Enabled monitors with first tick, period and last tick number."""
    first, last = F.unix_seconds(instant(start)), F.unix_seconds(instant(end))
    period = F.ceil(F.greatest(F.col("interval_secs"), F.lit(1)) / F.lit(poll)) * poll
    return (
        monitors.where("enabled")
        .withColumn("_first", first).withColumn("_period", period.cast("long"))
        .withColumn("_last", F.call_function("div", last - first - 1, F.col("_period"))))


def due_ticks(monitors: DataFrame, start, end, poll: int = POLL_SECONDS) -> DataFrame:
    """Evaluation times of every enabled monitor in [start, end).

    The first look is always due; after that a monitor is due at the first look at which its
    interval has passed.
    """
    return _ticks(_with_schedule(monitors, start, end, poll))


def _ticks(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("_last") >= 0).select(
        "tenant_id", "monitor_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_k"),
        "_first", "_period",
    ).select("tenant_id", "monitor_id",
             F.timestamp_seconds(F.col("_first") + F.col("_k") * F.col("_period"))
             .alias("tick"))


def _grid(plan: DataFrame) -> tuple[int, int]:
    """(width of a slot, longest window) in seconds.

    All ticks and windows begin and end on slots, counted from the first tick, so what falls into one slot
    counts in the same windows.  Monitors with very many different schedules have slots of a second.
    """
    pairs = plan.select("_period", "window_secs").distinct().limit(DRIVER_ROWS + 1).collect()
    if len(pairs) > DRIVER_ROWS:
        return 1, plan.agg(F.max("window_secs")).first()[0] or 0
    return max(1, gcd(*[n or 0 for pair in pairs for n in pair])), max((p.window_secs or 0 for p in pairs), default=0)


def _slot(ts: str, start, width: int) -> Column:
    """Second at which the slot of a time begins."""
    first = F.unix_seconds(instant(start))
    return F.floor((F.unix_seconds(ts) - first) / F.lit(width)) * width + first


def _covering(second: Column) -> Column:
    """Numbers of the ticks whose window [tick - w, tick) holds the slot that begins at ``second``."""
    since = second - F.col("_first")
    low = F.greatest(F.floor(since / F.col("_period")) + 1, F.lit(0).cast("long"))
    high = F.least(F.floor((since + F.col("window_secs")) / F.col("_period")), F.col("_last"))
    return F.when(low <= high, F.sequence(low, high))


def _windows_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (tenant_id, service, _sec, ...) repeated for every monitor tick they count in."""
    keep = [c for c in rows.columns if c not in ("tenant_id", "service", "_sec")]
    ticks = plan.select("tenant_id", "service", "monitor_id", "_first", "_period", "_last",
                        "window_secs")
    return (
        rows.join(ticks, ["tenant_id", "service"])
        .select("tenant_id", "monitor_id", "_first", "_period",
                F.explode(_covering(F.col("_sec"))).alias("_k"), *keep)
        .withColumn("tick", F.timestamp_seconds(F.col("_first") + F.col("_k") * F.col("_period")))
        .select("tenant_id", "monitor_id", "tick", *keep))


_TICK = ["tenant_id", "monitor_id", "tick"]


def _tails(seen: DataFrame, plan: DataFrame, slot: Column, q: float = 0.99) -> DataFrame:
    """(tenant_id, monitor_id, tick, _p99): the exact quantile of each window with spans.

    Two passes over counts; no span is repeated.  The first counts the bands of each service and
    slot and adds them up per window, which tells the band of both wanted ranks.  The second
    counts single durations of those bands only, again per service and slot before the windows.
    """
    at = position(q)
    held = f"filter(array_distinct(array(floor({at}), ceil({at}))), r -> r >= _before AND r < _upto)"
    service = ["tenant_id", "service"]
    timed = (
        seen.where(F.col("duration_ns").isNotNull())
        .select(*service, slot.alias("_sec"),
                F.col("duration_ns").alias("_value"))
        .join(plan.select(*service).distinct(), service, "left_semi")
        .withColumn("_band", F.expr(log_band(TAIL_BANDS))))
    count, total = F.count(F.lit(1)).alias("_cnt"), F.sum("_cnt").alias("_cnt")
    bands = _windows_of(timed.groupBy(*service, "_sec", "_band").agg(count), plan).groupBy(
        *_TICK, "_band").agg(total)
    window = f"PARTITION BY {', '.join(_TICK)}"
    marks = (
        bands.selectExpr(*_TICK, "_band", "_cnt", f"sum(_cnt) OVER ({window}) AS _n",
                         f"sum(_cnt) OVER ({window} ORDER BY _band) - _cnt AS _before")
        .withColumn("_upto", F.expr("_before + _cnt"))
        .where(f"size({held}) > 0").select(*_TICK, "_band", "_before", "_n"))
    # Stored, so that the first pass runs once and the second is planned by the marks' real size:
    # few marks reach the spans without moving them.
    marks = cut_lineage(marks, "tail-marks")
    marked = (marks.join(plan.select(*service, "monitor_id"), ["tenant_id", "monitor_id"])
              .select(*service, "_band").distinct())
    single = (timed.join(marked, [*service, "_band"], "left_semi")
              .groupBy(*service, "_sec", "_band", "_value").agg(count))
    values = _windows_of(single, plan).groupBy(*_TICK, "_band", "_value").agg(total)
    placed = (
        values.join(marks, [*_TICK, "_band"])
        .withColumn("_upto", F.expr(
            f"_before + sum(_cnt) OVER ({window}, _band ORDER BY _value)"))
        .withColumn("_before", F.expr("_upto - _cnt"))
        .select(*_TICK, "_value", "_n", F.expr(f"explode({held}) AS _rank")))
    ends = placed.groupBy(*_TICK).agg(
        F.max("_n").alias("_n"),
        *[F.expr(f"max(IF(_rank = {end}({at}), _value, NULL)) AS _{end}")
          for end in ("floor", "ceil")])
    return ends.selectExpr(*_TICK, between("_floor", "_ceil", at, "_p99"))


def monitor_values(monitors: DataFrame, spans: DataFrame, logs: DataFrame, start, end,
                   poll: int = POLL_SECONDS) -> DataFrame:
    """Value of every enabled monitor at every tick, also where no row matched.

    Runs small jobs over the monitors and the first pass of the p99 windows.  Spans are first reduced to one
    row per service and slot of time (and duration band, for p99), so a service with a third of all rows costs the join no
    more than any other; only those cells meet the monitors.  error_rate and counts are 0
    without data, avg and p99 null.  Ticks and windows are whole seconds.
    """
    # Monitors are read first: the joins are planned by their real number, and the longest
    # window bounds the scan with plain literals.
    plan = with_known_size(_with_schedule(monitors, start, end, poll))
    width, reach = _grid(plan)
    earliest = F.timestamp_seconds(F.unix_seconds(instant(start)) - reach)
    seen = in_range(spans, "start_time", earliest, end)
    cells = (
        seen.groupBy("tenant_id", "service", _slot("start_time", start, width).alias("_sec"))
        .agg(F.count(F.lit(1)).alias("_n"),
             F.sum(F.when(is_error(), 1).otherwise(0)).alias("_errors"),
             F.sum(F.col("duration_ns").cast("double")).alias("_ns")))
    log_cells = (
        in_range(logs, "timestamp", earliest, end)
        .where(F.col("severity_number") >= LOG_ERROR_FLOOR)
        .groupBy("tenant_id", "service", _slot("timestamp", start, width).alias("_sec"))
        .agg(F.count(F.lit(1)).alias("_n")))
    is_log, is_p99 = F.col("kind") == "log", F.col("aggregation") == "p99"
    sums = _windows_of(cells, plan.where(~is_log & ~is_p99)).groupBy(*_TICK).agg(
        F.sum("_n").alias("_n"), F.sum("_errors").alias("_errors"), F.sum("_ns").alias("_ns"))
    log_sums = _windows_of(log_cells, plan.where(is_log)).groupBy(*_TICK).agg(
        F.sum("_n").alias("_logs"))
    tails = _tails(seen, plan.where(~is_log & is_p99), _slot("start_time", start, width))
    n = F.coalesce("_n", F.lit(0))
    value = (
        F.when(is_log, F.coalesce("_logs", F.lit(0)).cast("double"))
        .when(F.col("aggregation") == "error_rate",
              F.coalesce("_errors", F.lit(0)) / F.greatest(n, F.lit(1)))
        .when(is_p99, F.col("_p99") / 1e6)
        .when(F.col("aggregation") == "avg", F.try_divide(F.col("_ns"), n) / 1e6)
        .otherwise(n.cast("double")))
    return (
        _ticks(plan)
        .join(plan.select("tenant_id", "monitor_id", "kind", "aggregation", "op", "threshold"),
              ["tenant_id", "monitor_id"])
        .join(sums, _TICK, "left").join(log_sums, _TICK, "left").join(tails, _TICK, "left")
        .select(*_TICK, "op", "threshold", value.alias("value")))


def evaluate_monitors(monitors: DataFrame, spans: DataFrame, logs: DataFrame, start, end,
                      poll: int = POLL_SECONDS) -> DataFrame:
    """(tenant_id, monitor_id, tick, value, violated) for every due tick."""
    values = monitor_values(monitors, spans, logs, start, end, poll)
    return values.select(
        *_TICK, "value",
        violated(F.col("op"), F.col("value"), F.col("threshold")).alias("violated"))
