"""Rank selection and first-k against brute force, also for one hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import ranks, topk
from conftest import at

QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        value = 5 if rng.random() < 0.3 else int(rng.lognormvariate(15, 3))
        rows.append((key, value, i % 7))
    return rows


def expected(values):
    return [float(np.percentile(values, q * 100)) for q in QS.values()]


def close(got, want):
    return all(abs(g - w) <= 1e-9 * max(1.0, abs(w)) for g, w in zip(got, want))


def by_key(rows):
    groups = {}
    for key, value, _ in rows:
        groups.setdefault(key, []).append(value)
    return groups


PATHS = [(1_000_000, False), (500, False), (500, True), (1, True), (0, False)]


@pytest.mark.parametrize("bound, split", PATHS)
def test_grouped_quantiles(spark, skewed, bound, split):
    df = spark.createDataFrame(skewed, "k string, v long, e int")
    found = ranks.exact_quantiles(df, "v", QS, ["k"], {"e": F.col("e")}, split=split,
                                  buffer_rows=bound).collect()
    groups = by_key(skewed)
    assert sorted(r.k for r in found) == sorted(groups)
    for row in found:
        assert row.n == len(groups[row.k])
        assert close([row.p50, row.p95, row.p99], expected(groups[row.k]))
        assert row.e == sum(e for k, _, e in skewed if k == row.k)


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_global_quantiles_and_empty(spark, skewed, bound):
    df = spark.createDataFrame(skewed, "k string, v long, e int")
    row = ranks.exact_quantiles(df, "v", QS, buffer_rows=bound).first()
    assert close([row.p50, row.p95, row.p99], expected([v for _, v, _ in skewed]))
    for quantiles in (ranks.exact_quantiles, ranks.banded_quantiles):
        none = quantiles(df.where("v < 0"), "v", QS).collect()
        assert len(none) == 1 and none[0].n == 0 and none[0].p50 is None


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_negative_values_and_null_keys(spark, bound):
    data = [(None, v) for v in (-8, -3, 0, 4, 90)] + [("a", None), ("a", 7)]
    df = spark.createDataFrame(data, "k string, v long")
    rows = ranks.exact_quantiles(df, "v", QS, ["k"], split=True, buffer_rows=bound).collect()
    found = {r.k: r for r in rows}
    assert close([found[None].p50, found[None].p95], expected([-8, -3, 0, 4, 90])[:2])
    assert found["a"].n == 1 and found["a"].p99 == 7.0


def test_marks_too_many_for_the_driver_are_written(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed, "k string, v long, e int")
    asked = []
    real = ranks.with_known_size
    monkeypatch.setattr(ranks, "with_known_size",
                        lambda d: asked.append(1) or real(d, limit=5))
    rows = ranks.banded_quantiles(df, "v", QS, ["k"]).collect()
    groups = by_key(skewed)
    assert asked and len(rows) == len(groups)
    assert all(close([r.p50, r.p95, r.p99], expected(groups[r.k])) for r in rows)


@pytest.fixture(scope="module")
def timed():
    rng = random.Random(3)
    # A third of the rows share one instant.
    return [(at(100) if i % 3 == 0 else at(rng.randrange(0, 90_000) / 60), f"{i:05d}")
            for i in range(4000)]


@pytest.mark.parametrize("newest", [False, True])
@pytest.mark.parametrize("k", [1, 50, 1500, 3999, 9000])
@pytest.mark.parametrize("lanes", [True, False])
def test_first_by_time(spark, timed, monkeypatch, k, newest, lanes):
    monkeypatch.setattr(topk, "LANE_LIMIT", 10_000 if lanes else 0)
    df = spark.createDataFrame(timed, "ts timestamp, id string").repartition(7)
    got = [(r.ts, r.id) for r in topk.first_by_time(df, "ts", k, ["id"], newest).collect()]
    want = sorted(timed, key=lambda r: r[1])
    want = sorted(want, key=lambda r: r[0], reverse=newest)[:k]
    assert got == want


def test_lanes_prune_before_the_shuffle(spark, timed):
    df = spark.createDataFrame(timed, "ts timestamp, id string")
    plan = topk.top_k(df, [F.col("ts"), F.col("id")], 10)._jdf.queryExecution().toString()
    partial = plan.index("WindowGroupLimit", plan.index("Physical Plan"))
    assert "Partial" in plan[partial:]
