"""Packing, retention, dead letters and lookups over stored tables."""

import json
import os
import time
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.functions.text import match_tokens, words
from spanlake.schemas import LOGS, SPANS
from spanlake.sources import lookup, otlp, tables, upkeep
from spanlake.streaming import ingest
from spanlake.streaming.ingest import DEAD_LETTERS, stream_ingest
from conftest import at


def span_message(k, name=None):
    start = 1_709_251_200_000_000_000 + k * 7_200_000_000_000
    span = {"traceId": f"{k % 11:032x}", "spanId": f"{k:016x}", "name": name or f"n{k}",
            "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 5000 + k)}
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]})


def rows_of(df):
    return sorted((r.span_id, r.name, r.start_time, r.duration_ns, r.trace_id) for r in df.collect())


@pytest.fixture
def ingested(spark, tmp_path):
    """A stream of 200 messages in five batches, with every ninth broken."""
    messages = [span_message(k)[:40] if k % 9 == 4 else span_message(k) for k in range(200)]
    for part in range(5):
        spark.createDataFrame([(m,) for m in messages[part::5]], "value string").coalesce(1).write.mode("append").text(
            str(tmp_path / "in"))
    root = str(tmp_path)
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{root}/in")
    run = stream_ingest(stream, "traces", f"{root}/spans", f"{root}/c", {"availableNow": True}, f"{root}/dead")
    run.awaitTermination()
    return root, messages, run


def test_dead_letters_and_counts(spark, ingested):
    root, messages, run = ingested
    bad = [m for k, m in enumerate(messages) if k % 9 == 4]
    dead = spark.read.schema(DEAD_LETTERS).parquet(f"{root}/dead").collect()
    assert sorted(r.value for r in dead) == sorted(bad) and {r.reason for r in dead} == {"malformed JSON"}
    want = otlp.flatten_traces(spark.createDataFrame([(m,) for m in messages], "value string"))
    assert rows_of(tables.scan(spark, f"{root}/spans", SPANS)) == rows_of(want)
    counts = [p.observedMetrics["ingest"] for p in run.recentProgress if "ingest" in p.observedMetrics]
    assert (sum(c.good for c in counts), sum(c.bad for c in counts)) == (200 - len(bad), len(bad))


def test_a_large_batch_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Also if all spans have the same time: no task sorts the whole batch."""
    monkeypatch.setattr(ingest, "ROWS_PER_TASK", 50)
    root = str(tmp_path)
    messages = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"name": f"s{k}"}]}]}]}) for k in range(400)]
    spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1).write.text(f"{root}/in")
    stream = spark.readStream.format("text").load(f"{root}/in")
    stream_ingest(stream, "traces", f"{root}/spans", f"{root}/c", {"availableNow": True}, f"{root}/dead").awaitTermination()
    stored = spark.read.parquet(f"{root}/spans")
    assert sorted(r.name for r in stored.collect()) == sorted(f"s{k}" for k in range(400))
    each = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(each) > 4 and max(each) < 200


def test_replayed_batch_adds_nothing(spark, ingested):
    import glob
    import os

    root, messages, _ = ingested
    before = rows_of(tables.scan(spark, f"{root}/spans", SPANS))
    last = max(glob.glob(f"{root}/c/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for name in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(name):
            os.unlink(name)
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{root}/in")
    stream_ingest(stream, "traces", f"{root}/spans", f"{root}/c", {"availableNow": True},
                  f"{root}/dead").awaitTermination()
    assert rows_of(tables.scan(spark, f"{root}/spans", SPANS)) == before
    assert spark.read.schema(DEAD_LETTERS).parquet(f"{root}/dead").count() == len(messages) - len(before)


def files(spark, path):
    return [f for _, folder in upkeep.day_folders(spark, path) for f, _ in upkeep.data_files(spark, f"{path}/{folder}")]


def test_compaction_keeps_rows_and_packs_files(spark, ingested):
    path = f"{ingested[0]}/spans"
    before, n = rows_of(tables.scan(spark, path, SPANS)), len(files(spark, path))
    packed = upkeep.compact(spark, path, "spans", SPANS, "2024-03-15")
    days = [d for d, _ in upkeep.day_folders(spark, path)]
    assert packed == sum(d < "2024-03-15" for d in days) and len(files(spark, path)) < n
    closed = [f for f in files(spark, path) if f.split("date=")[1][:10] < "2024-03-15"]
    assert len(closed) == packed and all("/batch=0/" in f for f in closed)
    assert rows_of(tables.scan(spark, path, SPANS)) == before
    assert upkeep.compact(spark, path, "spans", SPANS, "2024-03-15") == 0


@pytest.mark.parametrize("dies_at", ["delete", "write"])
def test_a_swap_that_dies_is_finished(spark, ingested, monkeypatch, dies_at):
    path = f"{ingested[0]}/spans"
    before = rows_of(tables.scan(spark, path, SPANS))
    kept = {"delete": upkeep.delete_folder, "write": upkeep.write_table}[dies_at]
    calls = []

    def dying(*args, **kwargs):
        calls.append(1)
        if len(calls) == (3 if dies_at == "delete" else 1):
            raise RuntimeError("lost")
        return kept(*args, **kwargs)

    monkeypatch.setattr(upkeep, {"delete": "delete_folder", "write": "write_table"}[dies_at], dying)
    with pytest.raises(RuntimeError):
        upkeep.compact(spark, path, "spans", SPANS, "2024-04-01")
    monkeypatch.undo()
    upkeep.compact(spark, path, "spans", SPANS, "2024-04-01")
    assert rows_of(tables.scan(spark, path, SPANS)) == before


def test_sweep_removes_days_and_cuts_the_edge(spark, make_spans, tmp_path):
    path = str(tmp_path / "spans")
    spans = make_spans([(h * 60, "a", h, 1) for h in range(24 * 5)])
    tables.write_table(spans, path, "spans")
    # Thirty days after T0 plus 2 days and 6 hours.
    gone, cut = upkeep.sweep(spark, path, "spans", SPANS, at(32 * 24 * 60 + 360))
    assert (gone, cut) == (2, 1)
    assert [d for d, _ in upkeep.day_folders(spark, path)] == ["2024-03-03", "2024-03-04", "2024-03-05"]
    assert sorted(r.duration_ns for r in tables.scan(spark, path, SPANS).collect()) == list(range(54, 120))
    assert upkeep.sweep(spark, path, "spans", SPANS, at(32 * 24 * 60 + 360)) == (0, 1)


@pytest.fixture
def stored_logs(spark, tmp_path):
    rows = [("default", at(k * 60), f"{k % 9:032x}", "", 9, "INFO", f"s{k % 3}", "prod",
             None if k == 7 else f"common day{k // 24} word{k} x-y" + (" rare" if k in (30, 100) else ""), [], [])
            for k in range(24 * 6)]
    path = str(tmp_path / "logs")
    tables.write_table(spark.createDataFrame(rows, LOGS), path, "logs")
    lookup.index_tokens(spark, path, str(tmp_path / "tokens"))
    return path, str(tmp_path / "tokens")


def read_files(df):
    return {f.split("date=")[1][:10] for f in df.inputFiles()}


def bodies(df):
    return sorted(r.body for r in df.collect())


@pytest.mark.parametrize("query, days", [("rare", 2), ("rare day4", 1), ("word30 rare", 1), ("common", 6), ("y", 6),
                                         ("nowhere", 0), ("x-y", 0), ("Rare", 0)])
def test_token_lookup_equals_search(spark, stored_logs, query, days):
    path, index = stored_logs
    got = lookup.search_tokens(spark, path, index, query)
    plain = tables.scan(spark, path, LOGS).where(match_tokens(F.col("body"), query))
    assert bodies(got) == bodies(plain)
    assert len(got.limit(1).inputFiles() and read_files(got) if bodies(got) else ()) == days


def test_file_words_come_once_a_file(monkeypatch):
    """Over batches and cuts of a file; what no longer fits goes out early."""
    bodies = ["a b,a", None, "", "-é--b\x00c", "x" * 50, "b"]
    rows = [("t", date(2024, 3, 1), f, b) for f in ("f1", "f1", "f2") for b in bodies]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.date32(), pa.string(), pa.string()))]
    whole = pa.RecordBatch.from_arrays(columns, ["tenant_id", "date", "file", "body"])
    batches = [whole.slice(0, 4), whole.slice(4, 0), whole.slice(4, 7), whole.slice(11)]
    monkeypatch.setattr(lookup, "CHARS_AT_ONCE", 20)
    monkeypatch.setattr(lookup, "ROWS_AT_ONCE", 2)
    every = ["", "a", "b", "c", "x" * 50, "é"]

    def found():
        got = [r for b in lookup._file_words(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        return sorted((f, w) for t, d, f, w in got if (t, d) == ("t", date(2024, 3, 1)))

    assert found() == [(f, w) for f in ("f1", "f2") for w in every]
    monkeypatch.setattr(lookup, "HELD_WORDS", 1)
    assert set(found()) == {(f, w) for f in ("f1", "f2") for w in every}


def test_token_index_has_the_words_of_each_file(spark, stored_logs):
    path, index = stored_logs
    logs = spark.read.schema(LOGS).parquet(path).select(
        F.regexp_extract("_metadata.file_path", "(tenant_id=.*)$", 1).alias("file"),
        F.explode(F.concat(F.array(F.lit("")), words(F.coalesce("body", F.lit(""))))).alias("token")).distinct()
    got = [(r.file, r.token) for r in spark.read.parquet(index).select("file", "token").collect()]
    assert sorted(got) == sorted((r.file, r.token) for r in logs.collect())


def shuffle_bytes(spark):
    """Bytes of shuffle files on local disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = (os.path.join(at, f) for d in folders for at, _, names in os.walk(str(d)) for f in names)
    return sum(os.path.getsize(f) for f in files if "shuffle_" in f and os.path.exists(f))


def shuffles_left(spark, before):
    """Bytes of shuffle files beyond ``before``, as soon as there are none or after ten seconds."""
    ends = time.time() + 10
    while (left := shuffle_bytes(spark) - before) > 0 and time.time() < ends:
        time.sleep(0.2)
    return max(left, 0)


@pytest.fixture
def many_logs(spark):
    """Two logs an hour of four days and 300 in one second of the fifth, some without a time or a body."""
    times = [at(30 * k) for k in range(2 * 24 * 4)] + [at(4 * 24 * 60)] * 300 + [None] * 3
    return spark.createDataFrame(
        [("default" if k % 5 else "other", t, f"{k % 9:032x}", f"s{k}", 9, "INFO", f"s{k % 3}", "prod",
          None if k % 7 == 0 else f"w{k} " * 20, ["k"], [None if k % 4 else "v"]) for k, t in enumerate(times)], LOGS)


def log_rows(df):
    return sorted((r.tenant_id, r.span_id, r.timestamp or at(0), r.body or "", str(r.date)) for r in df.collect())


def test_pieces_meet_each_row_once(spark, many_logs):
    """Also rows without a time, and a second with more than a piece may have."""
    for split in (True, False):
        pieces = tables._pieces(many_logs, "timestamp", 10_000, split)
        found = [many_logs.where(p) for p in pieces]
        sizes = [f.agg(F.sum(tables._row_bytes(f)).alias("n")).first().n or 0 for f in found]
        assert sorted(r.span_id for f in found for r in f.collect()) == sorted(r.span_id for r in many_logs.collect())
        # A day has 48 logs of about 220 bytes, the second 300.
        assert len(pieces) > (8 if split else 4) and (max(sizes) < 20_000 if split else max(sizes) > 40_000)
    assert len(tables._pieces(many_logs, "timestamp", 1 << 30, True)) == 1
    assert tables.packed([("a", 3), ("b", 2), ("c", 9), ("d", 1)], 5) == [["a", "b"], ["c"], ["d"]]
    assert tables.packed([], 5) == []


@pytest.mark.parametrize("batch", [None, 3])
def test_a_table_written_in_pieces_is_the_same(spark, many_logs, tmp_path, batch):
    at_once, pieces = str(tmp_path / "at_once"), str(tmp_path / "pieces")
    tables.write_table(many_logs, at_once, "logs", batch=batch)
    before = shuffle_bytes(spark)
    tables.write_table(many_logs, pieces, "logs", batch=batch, at_once=30_000)
    assert shuffles_left(spark, before) == 0
    read = [spark.read.schema(LOGS).parquet(p) for p in (at_once, pieces)]
    assert log_rows(read[0]) == log_rows(read[1]) and read[1].count() == 495
    if batch is not None:
        tables.write_table(many_logs, pieces, "logs", batch=batch, at_once=30_000)
        assert spark.read.schema(LOGS).parquet(pieces).count() == 495
    tables.write_table(many_logs.limit(0), str(tmp_path / "none"), "logs", at_once=10_000)
    assert spark.read.schema(LOGS).parquet(str(tmp_path / "none")).count() == 0


def test_token_index_by_days(spark, many_logs, tmp_path, monkeypatch):
    """Few days at once give the index of all at once, and leave no shuffles."""
    path, indexes = str(tmp_path / "logs"), [str(tmp_path / n) for n in ("all", "days", "late")]
    tables.write_table(many_logs, path, "logs")
    lookup.index_tokens(spark, path, indexes[0])
    monkeypatch.setattr(lookup, "STORED_AT_ONCE", 1, raising=False)
    before = shuffle_bytes(spark)
    lookup.index_tokens(spark, path, indexes[1])
    assert shuffles_left(spark, before) == 0
    lookup.index_tokens(spark, path, indexes[2], ["2024-03-03", "2024-03-05", "2030-01-01"])
    found = [sorted(map(str, spark.read.parquet(i).collect())) for i in indexes]
    assert found[0] == found[1] and any("date=None" in r for r in found[0])
    assert found[2] == [r for r in found[0] if "date(2024, 3, 3)" in r or "date(2024, 3, 5)" in r]


def test_token_lookup_of_an_old_index_and_a_range(spark, stored_logs):
    path, index = stored_logs
    more = tables.scan(spark, path, LOGS).where("body LIKE '%word30 %'").drop("date").withColumn("body", F.lit("rare late"))
    tables.write_table(more, path, "logs")
    assert bodies(lookup.search_tokens(spark, path, index, "rare"))[0].startswith("common")
    assert "rare late" in bodies(lookup.search_tokens(spark, path, index, "rare"))
    upkeep.compact(spark, path, "logs", LOGS, "2024-03-04")
    assert len(bodies(lookup.search_tokens(spark, path, index, "rare"))) == 3
    lookup.index_tokens(spark, path, index, ["2024-03-02"])
    assert len(bodies(lookup.search_tokens(spark, path, index, "rare"))) == 3
    late = lookup.search_tokens(spark, path, index, "rare", at(3 * 24 * 60), at(6 * 24 * 60))
    assert len(bodies(late)) == 1 and read_files(late) == {"2024-03-05"}


def test_trace_lookup(spark, ingested):
    root = ingested[0]
    path, index = f"{root}/spans", f"{root}/traces"
    days = sorted({d for d, _ in upkeep.day_folders(spark, path)})
    lookup.index_traces(spark, path, index, days[:-2])
    for trace in (f"{3:032x}", "none", f"{k:032x}" if (k := 10) else ""):
        got = lookup.find_trace(spark, path, index, trace)
        plain = tables.scan(spark, path, SPANS).where(F.col("trace_id") == trace)
        assert rows_of(got) == rows_of(plain)
    lookup.index_traces(spark, path, index, days[-3:])  # one day again
    early = tables.scan(spark, path, SPANS).where(F.col("date") < days[1]).select("trace_id").limit(1)
    some = lookup.spans_of_traces(spark, path, index, early)
    assert rows_of(some) == rows_of(tables.scan(spark, path, SPANS).join(early, "trace_id", "left_semi"))


def test_trace_lookup_reads_the_days_named(spark, make_spans, tmp_path):
    path, index = str(tmp_path / "spans"), str(tmp_path / "traces")
    spans = make_spans([(h * 60, "a", h, 1) for h in range(24 * 9)]).withColumn(
        "trace_id", F.concat(F.lit("t"), F.to_date("start_time").cast("string")))
    tables.write_table(spans, path, "spans", bloom="trace_id")
    lookup.index_traces(spark, path, index)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    got = lookup.find_trace(spark, path, index, "t2024-03-04")
    plan = got._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert got.count() == 24 and "date" in folders and "2024-03-04" in folders and "start_time" not in folders
    assert "start_time" in plan.split("PushedFilters: ")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert lookup.find_trace(spark, path, index, "t2025-01-01").count() == 0
