"""Spans and logs of the same trace, and the span tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


def has_trace() -> Column:
    """False for '' and for the all-zero padding that stands for "no trace"."""
    return ~F.col("trace_id").rlike("^0*$")


def correlate_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Every traced log beside the span that wrote it; null span columns where that span is not
    stored or the log names none.

    The join key is trace and span, so a log meets at most one span: a busy trace never
    multiplies its logs by its spans.  A hot span is split by AQE skew handling.
    """
    left = logs.where(has_trace()).select(
        "tenant_id", "trace_id", "span_id", "timestamp", "severity_text", "body")
    right = spans.where(has_trace()).select(
        "tenant_id", "trace_id", "span_id", F.col("name").alias("span_name"),
        F.col("service").alias("span_service"), "start_time", "duration_ns", "status_code")
    return left.join(right, ["tenant_id", "trace_id", "span_id"], "left")


def trace_logs(logs: DataFrame, trace_id: str) -> DataFrame:
    """Logs of one trace, by time."""
    return logs.where((F.col("trace_id") == trace_id) & has_trace()).orderBy(
        "timestamp", "span_id")


_ID = ["tenant_id", "trace_id", "span_id"]


def trace_tree(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans with depth, root and an orphan flag (parent not in the data).

    Ancestor pointers double their reach each round, so a tree of depth d takes about log2(d)
    joins of the still unresolved spans.  Runs jobs: each round is written to the shared
    folder.  Rounds go on while they resolve spans, so there is no depth limit; spans on a
    parent cycle, which have no depth, come back with nulls.
    """
    rows = spans.where(F.col("trace_id") == trace_id) if trace_id is not None else spans
    nodes = rows.select(*_ID, "parent_span_id", "name", "service")
    known = nodes.select("tenant_id", "trace_id", F.col("span_id").alias("parent_span_id"),
                         F.lit(True).alias("_known"))
    child = nodes.where(F.col("parent_span_id") != "").join(
        known, ["tenant_id", "trace_id", "parent_span_id"], "left")
    root = nodes.where(F.col("parent_span_id") == "").withColumn("_known", F.lit(False))
    top = ~F.coalesce("_known", F.lit(False))
    tree = root.unionByName(child).select(
        *_ID, "parent_span_id", "name", "service",
        (top & (F.col("parent_span_id") != "")).alias("orphan"),
        F.when(~top, F.col("parent_span_id")).alias("_up"),
        F.when(top, 0).otherwise(1).alias("depth"),
        F.when(top, F.col("span_id")).alias("root_span_id"))
    written = cut_lineage(tree, "tree")
    is_open = F.col("_up").isNotNull()
    done, pending = [written.where(~is_open)], written.where(is_open)
    left = pending.count()
    while left:
        # Only the unresolved spans are joined and written again.
        above = reduce(DataFrame.unionByName, [*done, pending]).select(
            "tenant_id", "trace_id", F.col("span_id").alias("_up"),
            F.col("_up").alias("_next"), F.col("depth").alias("_more"),
            F.col("root_span_id").alias("_root"))
        moved = pending.join(above, ["tenant_id", "trace_id", "_up"]).select(
            *_ID, "parent_span_id", "name", "service", "orphan", F.col("_next").alias("_up"),
            (F.col("depth") + F.col("_more")).alias("depth"),
            F.col("_root").alias("root_span_id"))
        written = cut_lineage(moved, "tree")
        pending = written.where(is_open)
        done.append(written.where(~is_open))
        before, left = left, pending.count()
        if left == before:
            break
    cyclic = pending.withColumn("depth", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, [*done, cyclic]).drop("_up")
