"""Profile messages (JSON lines) to profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.codes import natural_id

MESSAGE = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("service", T.StringType()),
    T.StructField("env", T.StringType()), T.StructField("profile_type", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()), T.StructField("data_base64", T.StringType()),
])

# Defaults for absent message fields.
DEFAULTS = {"tenant_id": "default", "service": "unknown", "env": "production",
            "profile_type": "cpu"}


def _field(name: str) -> Column:
    value = F.col(f"_m.{name}")
    return F.when(F.coalesce(value, F.lit("")) == "", DEFAULTS[name]).otherwise(value)


def profile_rows(raw: DataFrame) -> DataFrame:
    """Profile rows; messages that do not parse or lack time or payload are dropped.

    The id is derived from the content, so replaying a message gives the same row.
    """
    parsed = raw.select(F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("_m"))
    good = parsed.where(F.col("_m.timestamp_ns").isNotNull()
                        & F.col("_m.data_base64").isNotNull())
    micros = F.call_function("div", F.col("_m.timestamp_ns"), F.lit(1000))
    return good.select(
        _field("tenant_id").alias("tenant_id"), F.timestamp_micros(micros).alias("timestamp"),
        _field("service").alias("service"), _field("env").alias("env"),
        natural_id(_field("tenant_id"), _field("service"), _field("env"),
                   _field("profile_type"), F.col("_m.timestamp_ns"), F.col("_m.data_base64"))
        .alias("profile_id"),
        _field("profile_type").alias("type"), F.col("_m.data_base64").alias("payload"),
    )
