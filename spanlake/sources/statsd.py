"""StatsD packets to metric rows, with built-in expressions only.

A packet is one text row of any length; its lines are parsed inside the row.
Nothing shuffles, and the same code serves batch and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import instant

# Line types and the metric type each becomes (1 = counter, 0 = gauge).
LINE_TYPES = {"g": 0, "c": 1, "ms": 0, "h": 0, "s": 0}
MIN_RATE = 0.0001
# The numbers the protocol accepts; a cast alone would also take '1d' or '1f'.
# Longer than any text or array, so a cut with it goes to the end.
_ALL = 1 << 30
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _after_colon(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^[^:]*:", ""))


def _before_colon(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ":.*$", ""))


def _tags(extras: Column) -> Column:
    """Key/value structs of the '#...' parts; a tag without a value gets ''."""
    marked = F.filter(extras, lambda p: p.startswith("#"))
    pieces = F.flatten(F.transform(marked, lambda p: F.split(F.substring(p, 2, _ALL), ",")))
    pairs = F.transform(pieces, lambda t: F.struct(
        _before_colon(t).alias("key"),
        F.when(F.contains(t, F.lit(":")), _after_colon(t)).otherwise("").alias("value")))
    return F.filter(pairs, lambda t: t["key"] != "")


def parse_line(line: Column) -> Column:
    """``name:value|type[@rate][|@rate][|#k:v,k]`` as a struct, null where it is not valid."""
    text = F.trim(line)
    parts = F.transform(F.split(F.regexp_replace(text, "^[^:]*:", ""), "\\|"), lambda p: F.trim(p))
    extras = F.slice(parts, 3, _ALL)
    typed = F.split(F.get(parts, 1), "@")
    kind = F.trim(F.get(typed, 0))
    raw = _number(F.get(parts, 0))
    own_part = F.get(F.filter(extras, lambda p: p.startswith("@")), 0)
    rate = F.coalesce(_number(F.get(typed, 1)), _number(F.substring(own_part, 2, _ALL)), F.lit(1.0))
    value = (F.when(kind == "c", raw / F.greatest(rate, F.lit(MIN_RATE)))
             .when(kind == "s", F.lit(1.0)).otherwise(raw))
    code = F.when(kind == "c", LINE_TYPES["c"]).otherwise(0)
    valid = (F.contains(text, F.lit(":")) & (_before_colon(text) != "") & (F.size(parts) >= 2)
             & raw.isNotNull() & kind.isin(*LINE_TYPES))
    return F.when(valid, F.struct(_before_colon(text).alias("name"), value.alias("value"),
                                  code.alias("type"), _tags(extras).alias("tags")))


def _tag(tags: Column, *names: str) -> Column:
    hits = F.filter(tags, lambda t: t["key"].isin(*names))
    return F.get(hits, F.size(hits) - 1)["value"]


def _or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def statsd_rows(packets: DataFrame, received_at=None, default_tenant: str = "default",
                text: str = "value") -> DataFrame:
    """Metric rows of every valid line; bad lines are dropped.

    The tags of the first valid line of a packet name service and env for all its lines.
    ``received_at`` is an instant or a timestamp Column of ``packets``.
    """
    lines = F.transform(F.split(F.col(text), "\r?\n"), parse_line)
    valid = F.filter(lines, lambda m: m.isNotNull())
    first = F.get(F.col("_lines"), 0)["tags"]
    return (
        packets.select(instant(received_at).alias("timestamp"), valid.alias("_lines"))
        .select("timestamp", _tag(first, "service").alias("_service"),
                _tag(first, "env", "deployment.environment").alias("_env"),
                F.explode("_lines").alias("_m"))
        .select(
            F.lit(default_tenant).alias("tenant_id"), "timestamp", "_m.name", "_m.type",
            "_m.value", _or_default(F.col("_service"), "unknown").alias("service"),
            _or_default(F.col("_env"), "production").alias("env"),
            F.col("_m.tags.key").alias("attrs_keys"), F.col("_m.tags.value").alias("attrs_values"),
        )
    )
