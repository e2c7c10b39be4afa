"""Trace, log and metric export requests (OTLP/JSON lines) flattened to table rows.

The transforms are stateless selects and explodes: the same code serves batch and streams.
Input: a DataFrame with a text column ``value``, one export request per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.anyvalue import (
    KEY_VALUES, any_value_text, any_value_type, last_text, text_pairs,
)
from ..functions.codes import hex_id

#: Resource attribute that overrides the tenant; a deployment may name its own.
TENANT_ATTR = "tenant.id"

_S, _D = T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_RESOURCE = _struct(attributes=KEY_VALUES)

_SPAN = _struct(
    traceId=_S, spanId=_S, parentSpanId=_S, name=_S, kind=T.IntegerType(),
    startTimeUnixNano=_S, endTimeUnixNano=_S, attributes=KEY_VALUES,
    status=_struct(code=T.IntegerType(), message=_S),
)
_LOG = _struct(
    timeUnixNano=_S, severityNumber=T.IntegerType(), severityText=_S, body=any_value_type(),
    attributes=KEY_VALUES, traceId=_S, spanId=_S,
)
_NUMBER = _struct(timeUnixNano=_S, asDouble=_D, asInt=_S, attributes=KEY_VALUES)
_SUMMED = _struct(timeUnixNano=_S, sum=_D, attributes=KEY_VALUES)
_METRIC = _struct(
    name=_S,
    gauge=_struct(dataPoints=T.ArrayType(_NUMBER)),
    sum=_struct(dataPoints=T.ArrayType(_NUMBER)),
    histogram=_struct(dataPoints=T.ArrayType(_SUMMED)),
    summary=_struct(dataPoints=T.ArrayType(_SUMMED)),
)


def _request(outer: str, middle: str, inner: str, item: T.StructType) -> T.StructType:
    scope = _struct(**{inner: T.ArrayType(item)})
    resource = _struct(resource=_RESOURCE, **{middle: T.ArrayType(scope)})
    return _struct(**{outer: T.ArrayType(resource), "_corrupt": _S})


TRACES = _request("resourceSpans", "scopeSpans", "spans", _SPAN)
LOGS = _request("resourceLogs", "scopeLogs", "logRecords", _LOG)
METRICS = _request("resourceMetrics", "scopeMetrics", "metrics", _METRIC)


def _parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages with their parsed form ``_req``; messages that have it are not parsed again."""
    if "_req" in raw.columns:
        return raw
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("_req", F.from_json("value", schema, options))


def _or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def _items(raw: DataFrame, schema: T.StructType, default_tenant: str,
           tenant_attr: str, item_attrs: bool = True) -> DataFrame:
    """One row per innermost item ``_i`` and its ``_attrs``, with the resource fields beside."""
    outer = schema.fields[0].name
    resource_type = schema.fields[0].dataType.elementType
    middle = resource_type.fields[1].name
    inner = resource_type.fields[1].dataType.elementType.fields[0].name
    good = F.when(F.col("_req._corrupt").isNull(), F.col(f"_req.{outer}"))
    # Attribute texts are made once per resource; the optimizer keeps such a step separate.
    attrs = F.col("_res")
    return (
        _parsed(raw, schema).select(F.explode(good).alias("_r"))
        .select(text_pairs("_r.resource.attributes").alias("_res"), f"_r.{middle}")
        .select(
            F.coalesce(last_text(attrs, tenant_attr), F.lit(default_tenant))
            .alias("tenant_id"),
            _or_default(last_text(attrs, "service.name"), "unknown").alias("service"),
            _or_default(last_text(attrs, "deployment.environment"), "production").alias("env"),
            F.col("_res.key").alias("resource_keys"), F.col("_res.text").alias("resource_values"),
            F.explode(middle).alias("_s"),
        )
        .select("tenant_id", "service", "env", "resource_keys", "resource_values",
                F.explode(f"_s.{inner}").alias("_i"))
        .withColumn("_attrs", text_pairs("_i.attributes") if item_attrs else F.lit(None))
    )


def _nanos(text: str) -> Column:
    return F.coalesce(F.col(text).try_cast("long"), F.lit(0).cast("long"))


def _to_ts(nanos: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def _hex(path: str) -> Column:
    return F.lower(F.coalesce(F.col(path), F.lit("")))


def flatten_traces(raw: DataFrame, default_tenant: str = "default",
                   tenant_attr: str = TENANT_ATTR) -> DataFrame:
    """Span rows.  Duration never goes below zero; a missing status is unset."""
    start, end = _nanos("_i.startTimeUnixNano"), _nanos("_i.endTimeUnixNano")
    return _items(raw, TRACES, default_tenant, tenant_attr).select(
        "tenant_id", _hex("_i.traceId").alias("trace_id"), _hex("_i.spanId").alias("span_id"),
        _hex("_i.parentSpanId").alias("parent_span_id"),
        F.coalesce("_i.name", F.lit("")).alias("name"), "service", "env",
        F.coalesce("_i.kind", F.lit(0)).alias("kind"),
        _to_ts(start).alias("start_time"), _to_ts(end).alias("end_time"),
        start.alias("start_ns"),
        F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        F.coalesce("_i.status.code", F.lit(0)).alias("status_code"),
        F.coalesce("_i.status.message", F.lit("")).alias("status_msg"),
        F.col("_attrs.key").alias("attrs_keys"), F.col("_attrs.text").alias("attrs_values"),
        "resource_keys", "resource_values",
    )


def flatten_logs(raw: DataFrame, default_tenant: str = "default",
                 tenant_attr: str = TENANT_ATTR) -> DataFrame:
    """Log rows.  Ids are cut or right-padded to fixed width."""
    return _items(raw, LOGS, default_tenant, tenant_attr).select(
        "tenant_id", _to_ts(_nanos("_i.timeUnixNano")).alias("timestamp"),
        hex_id(F.col("_i.traceId"), 32).alias("trace_id"),
        hex_id(F.col("_i.spanId"), 16).alias("span_id"),
        F.coalesce("_i.severityNumber", F.lit(0)).alias("severity_number"),
        F.coalesce("_i.severityText", F.lit("")).alias("severity_text"),
        "service", "env", any_value_text("_i.body").alias("body"),
        F.col("_attrs.key").alias("attrs_keys"), F.col("_attrs.text").alias("attrs_values"),
    )


def flatten_metrics(raw: DataFrame, default_tenant: str = "default",
                    tenant_attr: str = TENANT_ATTR) -> DataFrame:
    """Metric rows of gauges (0), sums (1), histograms (2) and summaries (3).

    The four kinds become one array per metric, so the messages are parsed only once.
    Exponential histograms are left out.
    """
    number = lambda p: F.coalesce(p["asDouble"], p["asInt"].try_cast("double"), F.lit(0.0))
    summed = lambda p: F.coalesce(p["sum"], F.lit(0.0))
    kinds = [("gauge", 0, number), ("sum", 1, number), ("histogram", 2, summed),
             ("summary", 3, summed)]

    def points(kind: str, code: int, value) -> Column:
        row = lambda p: F.struct(
            F.lit(code).alias("type"), value(p).alias("value"),
            p["timeUnixNano"].alias("nanos"),
            p["attributes"].alias("attributes"))
        found = F.transform(F.col(f"_i.{kind}.dataPoints"), row)
        return F.coalesce(found, F.array())

    every = reduce(lambda a, b: F.concat(a, b), [points(*k) for k in kinds])
    millis = F.call_function("div", _nanos("_p.nanos"), F.lit(1_000_000))
    return (
        _items(raw, METRICS, default_tenant, tenant_attr, item_attrs=False)
        .select("tenant_id", F.coalesce("_i.name", F.lit("")).alias("name"), "service", "env",
                F.explode(every).alias("_p"))
        .withColumn("_attrs", text_pairs("_p.attributes"))
        .select("tenant_id", F.timestamp_millis(millis).alias("timestamp"), "name", "_p.type",
                "_p.value", "service", "env", F.col("_attrs.key").alias("attrs_keys"),
                F.col("_attrs.text").alias("attrs_values"))
    )


def marked(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages with their parsed form ``_req`` and a ``reason`` where they cannot be decoded, else null."""
    parsed = _parsed(raw, schema)
    bad = F.col("_req").isNull() | F.col("_req._corrupt").isNotNull()
    return parsed.withColumn("reason", F.when(F.col("value").isNull(), "empty message")
                             .when(bad, "malformed JSON"))


def split_bad(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(decodable messages, undecodable messages with a ``reason``)."""
    both = marked(raw, schema).drop("_req")
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL")
