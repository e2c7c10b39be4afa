"""Messages to rows, stored tables, rollups, profiles, correlation and scatter edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.functions.times import in_range
from spanlake.operators import correlate as C, flame as FL, profiles as P, rollup as R, xview as X
from spanlake.operators import logs as L, metrics as M
from spanlake.schemas import PROFILES, SPANS
from spanlake.sources import otlp, profiles as PR, tables
from spanlake.streaming.ingest import stream_ingest
from spanlake.streaming.rollup import stream_span_stats
from conftest import T0, at


def raw(spark, *messages):
    return spark.createDataFrame(
        [(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")


def kv(key, **value):
    return {"key": key, "value": value}


def traces(spans, attributes=None):
    resource = {} if attributes is None else {"resource": {"attributes": attributes}}
    return {"resourceSpans": [{**resource, "scopeSpans": [{"spans": spans}]}]}


SPAN = {"traceId": "AB" * 16, "spanId": "0C" * 8, "name": "get", "kind": 2,
        "startTimeUnixNano": "1700000000000000500", "endTimeUnixNano": "1700000000000002500",
        "status": {"code": 2, "message": "no"}, "attributes": [kv("n", intValue="3")]}


def test_trace_rows(spark):
    attributes = [kv("service.name", stringValue="api"), kv("tenant.id", stringValue="t9"),
                  kv("service.name", stringValue="api2")]
    backwards = {**SPAN, "startTimeUnixNano": "1700000000000009000", "status": None}
    rows = otlp.flatten_traces(raw(spark, traces([SPAN], attributes), traces([backwards]),
                                   "{broken")).orderBy("service").collect()
    assert len(rows) == 2
    known, bare = rows
    assert (known.tenant_id, known.service, known.env) == ("t9", "api2", "production")
    assert known.resource_keys == ["service.name", "tenant.id", "service.name"]
    assert known.trace_id == "ab" * 16 and known.parent_span_id == ""
    assert (known.duration_ns, known.status_code, known.status_msg) == (2000, 2, "no")
    assert known.start_ns == 1700000000000000500 and known.attrs_values == ["3"]
    assert (bare.tenant_id, bare.service) == ("default", "unknown")
    assert (bare.duration_ns, bare.status_code, bare.resource_keys) == (0, 0, [])


def test_log_rows(spark):
    record = {"timeUnixNano": "1700000000123456789", "severityNumber": 17, "severityText": "ERROR",
              "body": {"kvlistValue": {"values": [kv("a", doubleValue=1.0)]}}, "traceId": "abc"}
    message = {"resourceLogs": [{"scopeLogs": [{"logRecords": [record, {}]}]}]}
    full, empty = otlp.flatten_logs(raw(spark, message)).orderBy(F.desc("severity_number")).collect()
    assert full.trace_id == "abc" + "0" * 29 and full.span_id == "0" * 16
    assert full.body == "{a=1}" and empty.body == "" and empty.severity_number == 0


def test_metric_rows(spark):
    point = lambda **v: {"timeUnixNano": "1700000000999999999", **v}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [point(asInt="4"), point()]}},
        {"name": "s", "sum": {"dataPoints": [point(asDouble=2.5)]}},
        {"name": "h", "histogram": {"dataPoints": [point(sum=7.0), point(count="3")]}},
        {"name": "q", "summary": {"dataPoints": [point(sum=1.5)]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [point(sum=9.0)]}}]
    message = {"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]}
    rows = otlp.flatten_metrics(raw(spark, message)).collect()
    assert sorted((r.name, r.type, r.value) for r in rows) == [
        ("g", 0, 0.0), ("g", 0, 4.0), ("h", 2, 0.0), ("h", 2, 7.0), ("q", 3, 1.5), ("s", 1, 2.5)]
    assert {r.timestamp.microsecond for r in rows} == {999000}


def test_dead_letters(spark):
    good, bad = otlp.split_bad(raw(spark, traces([SPAN]), "{", "[1"), otlp.TRACES)
    assert (good.count(), bad.count()) == (1, 2)
    assert {r.reason for r in bad.collect()} == {"malformed JSON"}


def test_profile_messages(spark):
    message = {"service": "a", "timestamp_ns": 1_700_000_000_000_000_000, "data_base64": "AAA="}
    rows = PR.profile_rows(raw(spark, message, message, "{", {"service": "b"})).collect()
    assert len(rows) == 2 and rows[0].profile_id == rows[1].profile_id
    assert (rows[0].tenant_id, rows[0].env, rows[0].type) == ("default", "production", "cpu")


def test_write_prunes_and_replaces_days(spark, make_spans, tmp_path):
    path = str(tmp_path / "spans")
    spans = make_spans([(m * 60, "a", m, 1) for m in range(72)])
    tables.write_table(spans, path, "spans", bloom="trace_id")
    stored = tables.scan(spark, path, SPANS)
    assert stored.count() == 72
    day = in_range(stored, "start_time", at(24 * 60), at(30 * 60))
    assert day.count() == 6
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(date" in plan
    assert "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time" in plan
    tables.write_table(spans.where(F.col("duration_ns") < 10), path, "spans", mode="overwrite")
    assert tables.scan(spark, path, SPANS).count() == 10 + 48
    assert tables.retention_sweep(stored, "spans", at(31 * 24 * 60)).count() == 48


def test_stream_ingest_equals_batch(spark, tmp_path):
    messages = raw(spark, *[traces([{**SPAN, "name": f"n{i}"}]) for i in range(20)])
    messages.repartition(3).write.text(str(tmp_path / "in"))
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    run = stream_ingest(stream, "traces", str(tmp_path / "out"), str(tmp_path / "c"),
                        {"availableNow": True})
    run.awaitTermination()
    stored = tables.scan(spark, str(tmp_path / "out"), SPANS)
    names = [r.name for r in stored.collect()]
    assert sorted(names) == sorted(r.name for r in otlp.flatten_traces(messages).collect())


@pytest.fixture(scope="module")
def minute_spans(make_spans):
    return make_spans([(i % 37 / 2, f"s{i % 3}", (i * 7919) % 100_000, 2 if i % 9 == 0 else 1)
                       for i in range(3000)])


def test_rollup_stream_equals_batch(spark, minute_spans, tmp_path):
    minute_spans.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(minute_spans.schema).parquet(str(tmp_path / "in"))
    for exact in (True, False):
        out = str(tmp_path / f"out{exact}")
        run = (stream_span_stats(stream, delay="0 seconds", exact=exact).writeStream
               .format("parquet").option("path", out)
               .option("checkpointLocation", out + "c").trigger(availableNow=True).start())
        run.awaitTermination()
        got = spark.read.parquet(out)
        batch = R.span_stats(minute_spans).where(F.col("minute") < F.lit(at(18)))
        names = [*R.KEYS, "requests", "errors", "avg_ns"] + (list(R.QUANTILES) if exact else [])
        assert batch.count() == 54 == got.count()
        pair = [df.select(*names) for df in (got, batch)]
        assert pair[0].exceptAll(pair[1]).count() == 0


def test_merged_sketches_are_close(spark, minute_spans):
    parts = R.span_sketches(minute_spans).withColumn("minute", F.lit(T0))
    merged = {r.service: r for r in R.merge_span_stats(parts).collect()}
    for row in R.span_stats(minute_spans, "1 hour").collect():
        near = merged[row.service]
        assert (near.requests, near.errors) == (row.requests, row.errors)
        for q in R.QUANTILES:
            assert abs(near[q] - row[q]) <= 2000
        assert near.avg_ns == pytest.approx(row.avg_ns)


def test_profile_list_limits(spark):
    rows = [("default", at(i), "a", "prod", f"{i:032d}", "cpu", "x" * 7) for i in range(150)]
    df = spark.createDataFrame(rows, PROFILES)
    got = P.profiles_list(df, "a", at(0), at(149), limit=1000).collect()
    assert len(got) == 100 and got[0].id == f"{149:032d}" and got[0].size_bytes == 5
    assert P.profiles_list(df, "a", at(0), at(148)).count() == 10
    assert P.profiles_list(df, "a", at(0), at(148), type="heap").count() == 0
    plan = P.profiles_list(df, "a", at(0), at(148))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan


def test_symbolize_and_layout(spark):
    samples = spark.createDataFrame(
        [([1, 2, 9], 5), ([1, 2, 9], 2), ([3, 9], 1), ([77], 4), ([5], 4)],
        "location_ids array<long>, value long")
    # Location 2 holds an inlined call (two lines), 77 is unknown, 5 has an empty name.
    locations = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (2, 1, 3), (3, 0, 1), (5, 0, 5),
                                       (9, 0, 9)], "location_id long, line_no int, function_id long")
    functions = spark.createDataFrame([(f, f) for f in (1, 2, 3, 5, 9)],
                                      "function_id long, name_idx long")
    strings = spark.createDataFrame([(1, "leaf"), (2, "inner"), (3, "outer"), (5, ""), (9, "main")],
                                    "idx long, text string")
    folded = FL.symbolize(samples, locations, functions, strings)
    assert {(r.stack, r.value, r.samples) for r in folded.collect()} == {
        ("main;outer;inner;leaf", 7, 2), ("main;leaf", 1, 1)}
    stored = FL.symbolize(samples, locations, functions, strings, root_first=False)
    assert ("leaf;inner;outer;main",) in {(r.stack,) for r in stored.collect()}
    tree = FL.flame_tree(folded)
    nodes = {r.path: r for r in FL.flame_layout(tree).collect()}
    assert nodes[""].value == 8 and nodes["main"].self_value == 0
    assert (nodes["main;leaf"].x, nodes["main;leaf"].width) == (0.0, 0.125)
    assert nodes["main;outer;inner;leaf"].x == 0.125 and nodes["main;outer"].width == 0.875
    shares = {r.path: r.share for r in FL.flame_share(tree).collect()}
    assert shares["main;outer"] == 87.5


def test_folded_text(spark):
    rows = FL.folded_rows(raw(spark, "a;b c 12", "nonumber", "x;y 3")).collect()
    assert [(r.stack, r.value) for r in rows] == [("a;b c", 12), ("x;y", 3)]


def test_trace_tree_depth_orphans_and_cycles(spark):
    chain = [("t", f"n{i}", "" if i == 0 else f"n{i - 1}") for i in range(100)]
    odd = [("t", "o1", "gone"), ("t", "o2", "o1"), ("t", "c1", "c2"), ("t", "c2", "c1"),
           ("t", "c3", "c2"), ("u", "x", "n0")]
    df = spark.createDataFrame(
        [("default", t, s, p, "op", "svc") for t, s, p in chain + odd],
        "tenant_id string, trace_id string, span_id string, parent_span_id string, name string, "
        "service string")
    got = {r.span_id: (r.depth, r.root_span_id, r.orphan) for r in C.trace_tree(df).collect()}
    assert len(got) == 106
    assert all(got[f"n{i}"] == (i, "n0", False) for i in range(100))
    assert got["o1"] == (0, "o1", True) and got["o2"] == (1, "o1", False)
    assert got["c3"] == (None, None, False) and got["x"] == (0, "x", True)
    assert C.trace_tree(df, "u").count() == 1


def test_scatter_edges(spark, make_spans):
    spans = make_spans([(0, "a", 10, 2), (1, "a", 20, 0), (2, "b", 30, 1)])
    assert X.xview_stats(spans, at(5), at(6)).first().asDict() == {
        "total": 0, "errors": 0, "p50": 0, "p95": 0, "p99": 0}
    assert [r.s for r in X.xview_points(spans, at(0), at(2)).collect()] == [1, 0]
    points = X.as_points(spans)
    assert X.select_rect(points, 0, 10**15, 20, 30).count() == 2
    single = X.normalize(points.where(F.col("d") == 10)).first()
    assert single.nx is None and single.ny is None
    table = X.transactions_table(points, limit=2).collect()
    assert [r.overflow for r in table] == [1, 1]


def test_metric_queries(spark):
    df = spark.createDataFrame(
        [("m", at(0), 1.0, "a", "prod"), ("m", at(0.5), 3.0, "a", "prod"), ("m", at(2), 5.0, "b", "dev")],
        "name string, timestamp timestamp, value double, service string, env string")
    values = lambda **k: [r.v for r in M.query_range(df, "m", **k).collect()]
    assert values() == [2.0, 5.0] and values(agg="MAX") == [3.0, 5.0]
    assert values(agg="nonsense") == values(agg="avg")
    assert values(agg="rate") == [pytest.approx(4 / 60), pytest.approx(5 / 60)]
    assert len(values(step=0)) == 3 and values(service="b") == [5.0]
    grouped = M.query_range(df, "m", group_by=["env", "pod", "service"])
    assert grouped.columns == ["service", "env", "t", "v"]


def test_unknown_severity_filters_nothing(spark):
    df = spark.createDataFrame([(1,), (17,)], "severity_number int")
    assert L.severity_min_filter(df, "loud").count() == 2
    assert L.severity_min_filter(df, "error").count() == 1
