"""Tokens, intents, StatsD lines, attribute values, ids."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.functions import attrs, codes, text
from spanlake.functions.anyvalue import any_value_text, any_value_type, text_pairs
from spanlake.functions.times import auto_step, bucket_start, width_seconds
from spanlake.sources.statsd import parse_line, statsd_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("body, word, hit", [
    ("connection error", "error", True), ("errors", "error", False), ("(error)", "error", True),
    ("terror error", "error", True), ("Error", "error", False), ("éerror", "error", False),
    ("error\n", "error", True), ("a_error", "error", True), ("café au lait", "café", True),
    ("x a.b y", "a.b", False), ("aXb", "a.b", False), ("\U0001f600err", "err", False),
])
def test_has_token(spark, body, word, hit):
    assert one(spark, text.has_token(F.lit(body), word)) is hit


def test_all_words_must_match(spark):
    assert one(spark, text.match_tokens(F.lit("disk full on node7"), "full  node7"))
    assert not one(spark, text.match_tokens(F.lit("disk full on node7"), "full node"))


@pytest.mark.parametrize("message, want", [
    ("Why is it SLOW with errors?", "slow"), ("레이턴시가 높다", "slow"), ("many 5xx", "error"),
    ("실패가 늘었다", "error"), ("traffic?", "spike"), ("which service", "service"), ("hello", "general"),
])
def test_intent(spark, message, want):
    assert one(spark, text.intent(F.lit(message))) == want


@pytest.mark.parametrize("line, want", [
    ("a:1|c@0.5", ("a", 2.0, 1, {})), ("a:1|c|@0.1", ("a", 10.0, 1, {})),
    ("a:3|c@0", ("a", 30000.0, 1, {})), ("a:x|g", None), ("a:1", None), ("a:1|q", None),
    ("a:7|s", ("a", 1.0, 0, {})), ("a:0|g", ("a", 0.0, 0, {})), (":1|g", None), ("", None),
    ("a:1d|g", None), (" a : -2.5e1 | ms ", ("a", -25.0, 0, {})),
    ("a:1|g|#k:v,flag,:z, u:w:x ", ("a", 1.0, 0, {"k": "v", "flag": "", "u": "w:x"})),
    ("a:5|h@0.5", ("a", 5.0, 0, {})),
])
def test_statsd_line(spark, line, want):
    got = one(spark, parse_line(F.lit(line)))
    if want is None:
        assert got is None
    else:
        tags = {t.key: t.value for t in got.tags}
        assert (got.name, got.value, got.type, tags) == (
            want[0], pytest.approx(want[1]), want[2], want[3])


def test_statsd_packet_resource(spark):
    packet = "bad\na:1|c|#x:y\nb:2|g|#service:late,env:late"
    named = "a:1|c|#service:api,env:dev\nb:2|g"
    df = spark.createDataFrame([(packet,), (named,)], "value string")
    rows = statsd_rows(df, "2024-01-01").select("name", "service", "env").collect()
    assert sorted(map(tuple, rows)) == [
        ("a", "api", "dev"), ("a", "unknown", "production"),
        ("b", "api", "dev"), ("b", "unknown", "production")]


@pytest.mark.parametrize("value, want", [
    ({"stringValue": "x"}, "x"), ({"boolValue": True}, "true"), ({"intValue": "12"}, "12"),
    ({"doubleValue": 1e-40}, "0." + "0" * 39 + "1"), ({"doubleValue": 1e30}, "1" + "0" * 30),
    ({"doubleValue": 1.2345678901234567e-30}, "0." + "0" * 29 + "12345678901234567"),
    ({"doubleValue": -1.5e20}, "-15" + "0" * 19), ({"doubleValue": 123456789.125}, "123456789.125"),
    ({"arrayValue": {"values": [{"arrayValue": {"values": [{"arrayValue": {"values": [
        {"stringValue": "deep"}, {"intValue": "7"}]}}]}}]}},
     '[[[deep,7]]]'),
    ({"doubleValue": 5.0}, "5"), ({"doubleValue": 0.25}, "0.25"),
    ({"doubleValue": 1e16}, "10000000000000000"), ({"doubleValue": 12345678.5}, "12345678.5"),
    ({"doubleValue": 0.00001}, "0.00001"), ({"doubleValue": -2.0}, "-2"),
    ({"bytesValue": "AAEC/w=="}, "000102ff"), ({}, ""),
    ({"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "2"}]}}, "[a,2]"),
    ({"arrayValue": {"values": []}}, "[]"),
    ({"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": False}}]}}, "{k=false}"),
    ({"arrayValue": {"values": [{"kvlistValue": {"values": [
        {"key": "k", "value": {"stringValue": "v"}}]}}]}}, "[{k=v}]"),
])
def test_any_value(spark, value, want):
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    row = df.select(F.from_json("j", any_value_type()).alias("v")).select(any_value_text("v"))
    assert row.first()[0] == want


@pytest.mark.parametrize("raw, want", [("", "0" * 8), ("AB", "ab000000"), ("0123456789", "01234567")])
def test_hex_id(spark, raw, want):
    assert one(spark, codes.hex_id(F.lit(raw), 8)) == want


def test_duplicate_attributes(spark):
    df = spark.createDataFrame([(["k", "k"], ["first", "last"])],
                               "attrs_keys array<string>, attrs_values array<string>")
    row = df.select(attrs.attr_value("k").alias("v"), attrs.attrs_map().alias("m"),
                    attrs.attr_value("none").alias("gone")).first()
    assert (row.v, row.m["k"], row.gone) == ("first", "last", "")


def test_guardrails(spark):
    keys = [f"k{i}" for i in range(40)] + ["x"]
    df = spark.createDataFrame([(["Bad Key", "y" * 200] + keys, ["v" * 600] * 43)],
                               "attrs_keys array<string>, attrs_values array<string>")
    row = attrs.guard_attrs(df).first()
    assert len(row.attrs_keys) == 31 and row.attrs_dropped == 12
    assert len(row.attrs_keys[0]) == 128 and len(row.attrs_values[0]) == 512


def test_steps_and_widths(spark):
    assert auto_step(0, 3_600_000) == 30 and auto_step(0, 60_000) == 15
    assert width_seconds("2 hours") == 7200
    with pytest.raises(ValueError):
        width_seconds("soon")
    got = one(spark, bucket_start(F.lit("2024-01-01 10:47:12").cast("timestamp"), "15 minutes"))
    assert (got.hour, got.minute, got.second) == (10, 45, 0)


@pytest.mark.parametrize("number, want", [(0, "Info"), (1, "Trace"), (4, "Trace"), (5, "Debug"),
                                          (12, "Info"), (16, "Warn"), (17, "Error"),
                                          (24, "Fatal"), (25, "Info")])
def test_severity_band(spark, number, want):
    assert one(spark, codes.severity_band(F.lit(number))) == want


@pytest.mark.parametrize("name, want", [("warn", 13), ("WARNING", 13), ("what", None), (None, None)])
def test_severity_floor(name, want):
    assert codes.severity_floor(name) == want


@pytest.mark.parametrize("json, want", [
    ('{"arrayValue":{"values":[{"arrayValue":{"values":[{"arrayValue":{"values":[{"stringValue":"deep"},{"intValue":"7"}]}}]}}]}}',
     "[[[deep,7]]]"),
    ('{"arrayValue":{"values":[' * 40 + '{"doubleValue":5.0}' + ']}}' * 40, "[" * 40 + "5" + "]" * 40),
    ('{"kvlistValue":{"values":[{"key":"a","value":' * 9 + '{"boolValue":true}' + '}]}}' * 9, "{a=" * 9 + "true" + "}" * 9),
    ('{"arrayValue":{"values":[{"arrayValue":{"values":[{"arrayValue":{"values":[]}},{"arrayValue":{"values":[{"arrayValue":'
     '{"values":[{"stringValue":"{\\"arrayValue\\": 1}"}]}},{"kvlistValue":{}}]}}]}}]}}', '[[[],[[{"arrayValue": 1}],{}]]]'),
    ('{"stringValue":"plain"}', "plain"), ("{}", ""), (None, "")])
def test_values_of_any_depth(spark, json, want):
    df = spark.createDataFrame([(json,)], "json string").select(F.from_json("json", any_value_type()).alias("v"))
    assert df.select(any_value_text("v").alias("t")).first().t == want
    pairs = df.select(F.array(F.struct(F.lit("k").alias("key"), F.col("v").alias("value"))).alias("p"))
    assert [tuple(r) for r in pairs.select(text_pairs("p").alias("t")).first().t] == [("k", want)]
