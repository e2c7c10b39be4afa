"""Live tail and rule metrics of arriving logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.logs import DEFAULT_LIMIT, filter_logs, logs_search
from ..operators.rules import apply_rules

#: Rows a live view keeps.
VIEW_ROWS = 500


def stream_log_metrics(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows of arriving logs (no backfill): a stream-static join."""
    return apply_rules(logs, rules)


def stream_live_tail(logs: DataFrame, deliver: Callable[[DataFrame, int], None],
                     checkpoint: str, service: str | None = None, severity: str | None = None,
                     query: str | None = None, limit: int = VIEW_ROWS,
                     trigger: dict | None = None) -> StreamingQuery:
    """Every second, hand the newest matching entries to ``deliver(entries, batch_id)``."""

    def newest(batch: DataFrame, batch_id: int) -> None:
        deliver(logs_search(batch, limit=limit), batch_id)

    matching = filter_logs(logs, service=service, severity=severity, query=query)
    return (matching.writeStream.foreachBatch(newest)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


__all__ = ["DEFAULT_LIMIT", "VIEW_ROWS", "stream_live_tail", "stream_log_metrics"]
