"""Rules, monitors and incidents on hand-made rows; batch and stream agree."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanlake.operators import incidents as I, monitors as MO, rules as RU
from spanlake.schemas import MONITORS, RULES
from spanlake.streaming.incidents import incidents_stream, latest_status
from spanlake.streaming.logs import stream_live_tail, stream_log_metrics
from conftest import T0, at

LOGS = ("tenant_id string, timestamp timestamp, trace_id string, span_id string, "
        "severity_number int, severity_text string, service string, env string, body string, "
        "attrs_keys array<string>, attrs_values array<string>")


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        ("ERROR", 17, "pay", "card error, retry", ["ms"], ["12.5"]),
        ("INFO", 9, "pay", "errors: none", ["ms"], ["oops"]),
        ("WARN", 13, "web", "it's slow; ERROR 42", [], []),
        ("FATAL", 21, "web", "code=E-1234", ["ms", "ms"], ["1", "2"]),
    ]
    return spark.createDataFrame(
        [("default", at(i), f"{i:032x}", f"{i:016x}", n, s, svc, "prod", b, k, v)
         for i, (s, n, svc, b, k, v) in enumerate(rows)], LOGS)


def rule(metric, kind, value, field="", enabled=True, tenant="default"):
    return (tenant, metric, metric, "", kind, value, field, 0, "", enabled, T0)


def rules_of(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


@pytest.fixture(scope="module")
def rules(spark):
    return rules_of(
        spark, rule("kw", "keyword", "error"), rule("quote", "keyword", "it's"),
        rule("sev", "severity", "ERROR", "ms"), rule("svc", "service", "pay", "ms"),
        rule("re", "body_regex", "E-[0-9]{4}$", "ms"), rule("off", "service", "pay", enabled=False),
        rule("other", "service", "pay", tenant="t2"), rule("re2", "body_regex", "no+ne"),
        rule("kw2", "keyword", "error", "ms"))


WANT = [("kw", 1, 1.0, 0), ("kw2", 0, 12.5, 1), ("re", 0, 1.0, 2), ("re2", 1, 1.0, 0),
        ("sev", 0, 12.5, 1), ("svc", 0, 0.0, 1), ("svc", 0, 12.5, 1)]


def listed(df):
    return sorted((r.name, r.type, r.value, len(r.attrs_keys)) for r in df.collect())


@pytest.mark.parametrize("beside", [0, 1, 64, 65, 20_000])
def test_rules_whatever_their_number(spark, logs, rules, beside):
    more = spark.range(beside).select(
        F.lit("default").alias("tenant_id"), F.lit("idle").alias("metric_name"),
        F.lit("keyword").alias("filter_type"), F.concat(F.lit("idle"), "id").alias("filter_value"),
        F.lit("").alias("value_field"), F.lit(True).alias("enabled"))
    assert listed(RU.apply_rules(logs, rules.select(more.columns).unionByName(more))) == WANT


def test_many_keywords_leave_only_those_that_logs_hold(spark, logs, rules):
    """Of very many words the filter lets all pass, so the rules that no log can match go first."""
    columns = ["tenant_id", "metric_name", "filter_type", "filter_value", "value_field", "enabled"]
    idle = spark.range(RU.MANY_WORDS).selectExpr("'default'", "'idle'", "'keyword'", "concat('idle', id)", "''", "true")
    other = spark.createDataFrame([("t2", "far", "keyword", "error", "", True)], columns)
    found = RU.apply_rules(logs, rules.select(columns).union(idle).union(other))
    assert listed(found) == WANT
    held = spark.read.parquet(*found.inputFiles()).where("filter_type = 'keyword'")
    assert sorted(r.metric_name for r in held.collect()) == ["kw", "kw2"]


def test_rules_on_odd_rows(spark, logs):
    odd = logs.limit(1).select(*[F.lit(None).cast("string").alias("body") if c == "body"
                                 else F.lit("ERROR").alias(c) if c == "severity_text" else F.col(c)
                                 for c in logs.columns])
    some = rules_of(spark, rule("none", "keyword", ""), rule("sev", "severity", "ERROR"),
                    rule("kw", "keyword", "error"), rule("re", "body_regex", "zzz"),
                    rule("re_all", "body_regex", ".*"))
    assert [r[0] for r in listed(RU.apply_rules(odd, some))] == ["sev"]
    ends = logs.limit(1).withColumn("body", F.lit("-error-"))
    assert "none" not in [r[0] for r in listed(RU.apply_rules(ends, some))]


def test_no_rules_and_unknown_type(spark, logs, rules):
    assert RU.apply_rules(logs, rules.where(F.lit(False))).count() == 0
    with pytest.raises(Exception, match="unknown filter type"):
        RU.apply_rules(logs, rules_of(spark, rule("x", "magic", "y"))).collect()


def test_stream_rules_and_tail(spark, logs, rules, tmp_path):
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOGS).parquet(str(tmp_path / "in"))
    run = (stream_log_metrics(stream, rules).writeStream.format("parquet")
           .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
           .trigger(availableNow=True).start())
    run.awaitTermination()
    assert listed(spark.read.parquet(str(tmp_path / "out"))) == WANT
    seen = []
    run = stream_live_tail(stream, lambda df, _: seen.extend(r.body for r in df.collect()),
                           str(tmp_path / "c2"), severity="warn", limit=2,
                           trigger={"availableNow": True})
    run.awaitTermination()
    assert seen == ["code=E-1234", "it's slow; ERROR 42"]


def monitor(name, aggregation, op, threshold, kind="metric", service="a", window=120,
            interval=60, enabled=True):
    return ("default", name, name, kind, service, aggregation, window, op, float(threshold),
            "critical", enabled, interval)


def evaluated(spark, spans, logs, *rows, minutes=3):
    monitors = spark.createDataFrame(list(rows), MONITORS)
    out = MO.evaluate_monitors(monitors, spans, logs, T0, T0 + timedelta(minutes=minutes))
    return {(r.monitor_id, int((r.tick - T0).total_seconds())): (r.value, r.violated)
            for r in out.collect()}


def test_monitor_values_and_windows(spark, make_spans, logs):
    spans = make_spans([(0, "a", 2_000_000, 2), (0.5, "a", 4_000_000, 1),
                        (1, "a", 6_000_000, 1), (0, "b", 1, 1)])
    got = evaluated(
        spark, spans, logs, monitor("rate", "error_rate", "gte", 0.5),
        monitor("p99", "p99", "gt", 5), monitor("avg", "avg", "lte", 3),
        monitor("n", "whatever", "eq", 2), monitor("off", "count", "gt", 0, enabled=False),
        monitor("logs", "count", "gte", 1, kind="log", service="pay"))
    assert got["rate", 0] == (0.0, False) and got["rate", 60] == (0.5, True)
    assert got["rate", 120] == (pytest.approx(1 / 3), False)
    assert got["avg", 0] == (None, False) and got["avg", 60] == (3.0, True)
    assert got["p99", 120] == (pytest.approx(5.96), True)
    assert got["n", 60] == (2.0, True) and got["n", 120] == (3.0, False)
    assert got["logs", 60] == (1.0, True) and got["logs", 0] == (0.0, False)
    assert not [key for key in got if key[0] == "off"] and len(got) == 15


def test_no_data_still_evaluates(spark, make_spans, logs):
    got = evaluated(spark, make_spans([(0, "b", 1, 1)]), logs, monitor("low", "count", "lt", 1),
                    monitor("tail", "p99", "lt", 1), minutes=1)
    assert got["low", 0] == (0.0, True) and got["tail", 0] == (None, False)


def test_tails_of_overlapping_windows(spark, make_spans, logs):
    """Windows of half a minute and an hour every ten seconds against sorted lists."""
    rng = random.Random(5)
    rows = [(rng.random() * 20, rng.choice("ab"), int(10 ** rng.uniform(0, 10)), 1) for _ in range(600)]
    rows += [(3, "a", 7_000_000, 1)] * 40 + [(4, "b", 0, 1), (4, "b", 0, 1)]
    spans = make_spans(rows)
    own = [monitor(f"{s}{w}", "p99", "gt", 5, service=s, window=w, interval=10)
           for s in "abc" for w in (30, 3600)]
    got = evaluated(spark, spans, logs, *own, minutes=22)
    assert len(got) == 6 * 132
    for (name, tick), (value, _) in got.items():
        held = sorted(d for m, s, d, _ in rows if s == name[0]
                      and tick - int(name[1:]) <= int(m * 60 + 1e-9) < tick)
        if not held:
            assert value is None
            continue
        at = 0.99 * (len(held) - 1)
        low, high = held[int(at)], held[min(int(at) + 1, len(held) - 1)]
        assert value == pytest.approx((low + (high - low) * (at - int(at))) / 1e6, rel=1e-9, abs=1e-12)


def test_interval_is_rounded_up_to_the_poll(spark):
    monitors = spark.createDataFrame([monitor("m", "count", "gt", 0, interval=45)], MONITORS)
    ticks = [r.tick for r in MO.due_ticks(monitors, T0, T0 + timedelta(minutes=2)).collect()]
    assert [int((t - T0).total_seconds()) for t in sorted(ticks)] == [0, 50, 100]


EVAL = "tenant_id string, monitor_id string, tick timestamp, value double, violated boolean"
ACT = "tenant_id string, monitor_id string, at timestamp, action string"


def life(spark, letters):
    """Events from letters: V violation, N normal, A acknowledge, R resolve."""
    evals = [("default", "m", at(i), float(i), c == "V") for i, c in enumerate(letters) if c in "VN"]
    acts = [("default", "m", at(i), {"A": "acknowledge", "R": "resolve"}[c])
            for i, c in enumerate(letters) if c in "AR"]
    return spark.createDataFrame(evals, EVAL), spark.createDataFrame(acts, ACT)


def minutes(df):
    back = lambda t: None if t is None else int((t - T0).total_seconds() // 60)
    return sorted((back(r.triggered_at), back(r.resolved_at), r.status, r.trigger_value)
                  for r in df.collect())


@pytest.mark.parametrize("letters, want", [
    ("VVN", [(0, 2, "resolved", 0.0)]),
    ("VANVRV", [(0, 4, "resolved", 0.0), (5, None, "triggered", 5.0)]),
    ("VAN", [(0, None, "acknowledged", 0.0)]),
    ("NAVNAV", [(2, 3, "resolved", 2.0), (5, None, "triggered", 5.0)]),
    ("VRNRV", [(0, 1, "resolved", 0.0), (4, None, "triggered", 4.0)]),
    ("VRAV", [(0, 1, "resolved", 0.0), (3, None, "triggered", 3.0)]),
    ("NN", []),
])
def test_incident_life(spark, letters, want):
    evals, acts = life(spark, letters)
    assert minutes(I.incident_spans(I.as_events(evals, acts))) == want


def test_action_conflicts(spark):
    evals, acts = life(spark, "AVAARR")
    got = [(r.action, r.outcome) for r in I.action_outcomes(evals, acts).orderBy("at").collect()]
    assert got == [("acknowledge", "conflict"), ("acknowledge", "applied"),
                   ("acknowledge", "conflict"), ("resolve", "applied"), ("resolve", "conflict")]


def test_titles_list_and_message(spark):
    evals, acts = life(spark, "VAN")
    monitors = spark.createDataFrame([("default", "m", "Cpu", "metric", "a", "avg", 60, "gte",
                                       0.5, "critical", True, 60)], MONITORS)
    made = I.incidents_batch(evals, monitors, acts)
    assert made.first().title == "[CRITICAL] Cpu — 현재값 0.0000 (임계값 >= 0.5000)"
    assert I.incident_list(made, "default", "acknowledged").first().total == 1
    assert I.incident_list(made, "elsewhere").count() == 0
    message = I.incident_message(made).first().message
    assert '"color":"#FF0000"' in message and '"value":"ACKNOWLEDGED"' in message


def random_line(spark, seed=11, monitors=6, events=120):
    """Evaluations and actions of several monitors, many at equal times."""
    rng = random.Random(seed)
    evals, acts = [], []
    for m in range(monitors):
        for _ in range(events):
            c, i = rng.choice("VVNNAR"), rng.randrange(80)
            if c in "VN":
                evals.append(("default", f"m{m}", at(i), rng.random(), c == "V"))
            else:
                acts.append(("default", f"m{m}", at(i), {"A": "acknowledge", "R": "resolve"}[c]))
    return I.as_events(spark.createDataFrame(evals, EVAL), spark.createDataFrame(acts, ACT))


def plain_incidents(events):
    """(monitor, status, triggered, resolved, value) by folding the sorted events one by one."""
    out, now = [], {}
    key = lambda e: (e.at, e.step, e.kind, e.value is not None, e.value or 0.0)
    for e in sorted(events, key=key):
        found = now.get(e.monitor_id)
        if found is None and e.kind == "violation":
            now[e.monitor_id] = ["triggered", e.at, e.value]
        elif found and (e.kind == "resolve" or (e.kind, found[0]) == ("normal", "triggered")):
            out.append((e.monitor_id, "resolved", found[1], e.at, found[2]))
            del now[e.monitor_id]
        elif found and e.kind == "acknowledge":
            found[0] = "acknowledged"
    return sorted(out + [(m, s, t, None, v) for m, (s, t, v) in now.items()], key=str)


def listed_incidents(df):
    return sorted(((r.monitor_id, r.status, r.triggered_at, r.resolved_at, r.trigger_value)
                   for r in df.collect()), key=str)


def test_batch_with_equal_times_equals_a_fold(spark):
    line = random_line(spark).cache()
    want = plain_incidents(line.collect())
    assert len(want) > 50 and listed_incidents(I.incident_spans(line)) == want


def clock(line, minutes):
    return line.limit(1).select(
        F.lit("").alias("tenant_id"), F.lit("").alias("monitor_id"), F.lit(at(minutes)).alias("at"),
        F.lit(0).alias("step"), F.lit("clock").alias("kind"), F.lit(None).cast("double").alias("value"))


def run_incidents(spark, root, schema, delay):
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    run = (incidents_stream(stream, delay).writeStream.format("parquet").option("path", f"{root}/out")
           .option("checkpointLocation", f"{root}/c").outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return run


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    """Events dealt at random over files within the delay, in two runs that share a checkpoint."""
    line = random_line(spark).cache()
    pieces = line.randomSplit([1.0, 1.0, 1.0], 5)
    for k, piece in enumerate((*pieces, clock(line, 300))):
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 3):
            run_incidents(spark, tmp_path, line.schema, "100 minutes")
    got = latest_status(spark.read.parquet(str(tmp_path / "out")))
    batch = I.incident_spans(line)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_stream_state_over_batches_and_late_rows(spark, tmp_path):
    """Files by time, each folded before the next one comes; what lies behind the watermark counts for nothing."""
    line = random_line(spark, 3).cache()
    parts = [line.where((F.col("at") >= F.lit(at(low))) & (F.col("at") < F.lit(at(low + 20)))) for low in (0, 20, 40, 60)]
    late = line.where(F.col("kind") == "resolve").limit(5).withColumn("at", F.lit(at(1)))
    for part in (*parts[:3], late, parts[3], clock(line, 300)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_incidents(spark, tmp_path, line.schema, "1 minute")
    got = latest_status(spark.read.parquet(str(tmp_path / "out")))
    assert listed_incidents(got) == plain_incidents(line.collect())


@pytest.mark.parametrize("regex, literals", [
    ("th[ae]t?ou", ["th", "ou"]), ("[0-9]{3}-[0-9]{4}", ["-"]), ("E-[0-9]{4}$", ["E-"]), ("no+ne", ["n", "ne"]),
    (".*", []), ("a|b", []), ("(ab)?c", []), (r"a\d", []), ("ab*?c", ["a", "c"]), ("^x{2,3}y", ["y"]), ("abc", ["abc"]),
    ("[]a]b", []), ("[a&&b]c", []), ("[^ab]c", ["c"]), ("a[b-", []), ("", [])])
def test_literals_stand_in_every_match(spark, regex, literals):
    row = spark.range(1).select(RU._literals(F.lit(regex)).alias("got")).first()
    assert row.got == literals


def test_word_filter_loses_no_word(spark):
    """Every rule word passes, few others do."""
    rules = spark.range(20_000).select(
        F.lit("default").alias("tenant_id"), F.concat(F.lit("w"), "id").alias("filter_value"),
        F.lit("keyword").alias("filter_type"), F.lit(True).alias("enabled"))
    few, cells = RU._keywords(rules)
    seen = spark.range(40_000).select("id", F.concat(F.lit("w"), "id").alias("w")).withColumn("_cells", cells)
    hit = F.call_function("getbit", F.get("_cells", RU._cell(F.col("w"))), RU._bit(F.col("w"))) == 1
    got = seen.where(hit).agg(F.sum((F.col("id") < 20_000).cast("int")).alias("rules"), F.count("*").alias("all")).first()
    assert got.rules == 20_000 and got["all"] < 22_000
