"""Profile listing and lookup.  The payload is only read where it is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.times import in_range
from ..functions.topk import first_by_time

MAX_LISTED = 100


def profiles_list(profiles: DataFrame, service: str, start, end, type: str | None = None,
                  limit: int = 10) -> DataFrame:
    """Newest profiles of a service in the closed range, with an estimated byte size."""
    rows = in_range(profiles, "timestamp", start, end, closed=True).where(
        F.col("service") == service)
    if type is not None:
        rows = rows.where(F.col("type") == type)
    size = F.call_function("div", F.length("payload").cast("long") * 3, F.lit(4))
    # The size is taken before the sort, so payloads do not travel with it.
    slim = rows.select("profile_id", "service", "type", "timestamp", size.alias("size_bytes"))
    newest = first_by_time(slim, "timestamp", min(int(limit), MAX_LISTED), ["profile_id"],
                           newest=True)
    return newest.select(F.col("profile_id").alias("id"), "service", "type",
                         F.unix_millis("timestamp").alias("timestamp"), "size_bytes")


def profile_by_id(profiles: DataFrame, profile_id: str) -> DataFrame:
    return profiles.where(F.col("profile_id") == profile_id).limit(1)
