"""Detector thresholds, met exactly and just missed."""

import pytest
from pyspark.sql import functions as F

from spanlake.plans import anomaly as A, findings as G, patterns as P
from conftest import at


def counts(service, numbers):
    """Spans so that consecutive minutes hold the given numbers of requests."""
    return [(m, service, 1_000_000, 1) for m, n in enumerate(numbers) for _ in range(n)]


def by_service(df):
    return {r.service: r for r in df.collect()}


@pytest.mark.parametrize("history, last, confidence", [
    (9, 299, None), (9, 300, 0.7), (9, 1000, 1.0), (9, 2000, 1.0), (8, 300, None)])
def test_surge(make_spans, history, last, confidence):
    spans = make_spans(counts("a", [100] * history + [last]))
    got = by_service(P.detect_surge(P.surge_scores(spans)))
    if confidence is None:
        assert not got
    else:
        assert got["a"].confidence == pytest.approx(confidence)


@pytest.mark.parametrize("a, b, found", [(69, 31, False), (70, 30, True), (0, 0, False)])
def test_waterfall(make_spans, a, b, found):
    spans = make_spans([(0, "a", a * 1_000_000, 1), (0, "b", b * 1_000_000, 1)])
    got = by_service(P.detect_waterfall(P.waterfall_scores(spans)))
    assert ("a" in got) is found
    if found:
        assert got["a"].confidence == pytest.approx(0.5)


def test_waterfall_needs_two_services(make_spans):
    spans = make_spans([(0, "a", 1000, 1)])
    assert P.detect_waterfall(P.waterfall_scores(spans)).count() == 0


@pytest.mark.parametrize("rows, found", [(99, False), (100, True)])
def test_droplet_row_count(make_spans, rows, found):
    # One span is so slow that even the interpolated p99 is far above the mean.
    data = [(0, "a", 0, 1)] * (rows - 2) + [(0, "a", 10_000_000_000, 1)] * 2
    scores = P.droplet_scores(make_spans(data))
    assert (P.detect_droplet(scores).count() == 1) is found


def test_droplet_zero_mean(make_spans):
    assert P.detect_droplet(P.droplet_scores(make_spans([(0, "a", 0, 1)] * 150))).count() == 0


@pytest.mark.parametrize("buckets, found", [(24, False), (25, True)])
def test_wave_bucket_count(make_spans, buckets, found):
    numbers = [20 if m % 5 == 0 else 2 for m in range(buckets)]
    got = by_service(P.detect_wave(P.wave_scores(make_spans(counts("a", numbers)))))
    assert ("a" in got) is found


def test_wave_constant_series(make_spans):
    spans = make_spans(counts("a", [3] * 30))
    assert P.detect_wave(P.wave_scores(spans)).count() == 0


def test_patterns_are_ranked(make_spans):
    rows = counts("a", [100] * 9 + [700]) + [(0, "b", 10**10, 1)]
    got = P.detect_patterns(make_spans(rows)).collect()
    assert [r.pattern for r in got] == ["waterfall", "surge"]
    assert got[1].description == "[a] 서비스에 요청 급증 발생: 최근 1분 700건 (직전 평균의 7.0배)"
    assert got[0].confidence > got[1].confidence


def error_minutes(rates, per_minute=20):
    rows = []
    for minute, errors in enumerate(rates):
        rows += [(minute, "a", 1_000_000, 2 if i < errors else 1) for i in range(per_minute)]
    return rows


def scores_of(make_spans, rows, n):
    out = A.anomaly_scores(make_spans(rows), at(n), 60).collect()
    return {r.metric: r for r in out}


def test_anomaly_needs_five_buckets(make_spans):
    assert not scores_of(make_spans, error_minutes([1, 2, 1, 9]), 4)
    assert len(scores_of(make_spans, error_minutes([1, 2, 1, 2, 9]), 5)) == 2


def test_anomaly_score_at_threshold(make_spans):
    # History 2, 4, 2, 4 of 20: mean 0.15, population deviation 0.05.
    exact = scores_of(make_spans, error_minutes([2, 4, 2, 4, 6]), 5)["error_rate"]
    assert exact.score == pytest.approx(3.0) and exact.baseline == pytest.approx(0.15)
    drop = scores_of(make_spans, error_minutes([4, 6, 4, 6, 0]), 5)["error_rate"]
    assert drop.score == pytest.approx(5.0)
    found = A.detect_anomalies(make_spans(error_minutes([2, 4, 2, 4, 7])), at(5)).collect()
    assert [r.metric for r in found] == ["error_rate"] and found[0].service == "tenant:default"


def test_anomaly_constant_history(make_spans):
    assert scores_of(make_spans, error_minutes([2, 2, 2, 2, 20]), 5)["error_rate"].score == 0.0


def test_error_bands(make_spans):
    rows = []
    for service, errors in (("zero", 0), ("one", 1), ("low", 2), ("ten", 10), ("high", 11)):
        rows += [(0, service, 1, 2 if i < errors else 1) for i in range(100)]
    got = by_service(G.error_findings(make_spans(rows)))
    assert {s: r.severity for s, r in got.items()} == {
        "one": "info", "low": "warning", "ten": "warning", "high": "critical"}
    assert got["high"].message == "[high] 서비스 에러율 11.00%"
    general = by_service(G.general_findings(make_spans(rows)))
    assert set(general) == {"low", "ten", "high"}


@pytest.mark.parametrize("ms, want", [(1000, "info"), (1001, "warning"), (5000, "warning"),
                                      (5001, "critical")])
def test_latency_bands(make_spans, ms, want):
    found = G.latency_findings(make_spans([(0, "a", ms * 1_000_000, 1)])).first()
    assert found.severity == want


@pytest.mark.parametrize("errors, want", [(5, "info"), (6, "warning")])
def test_overview_band(make_spans, errors, want):
    rows = [(0, "a", 1, 2 if i < errors else 1) for i in range(100)]
    assert G.overview_findings(make_spans(rows)).first().severity == want


def test_summary_of_nothing(make_spans):
    row = G.system_summary(make_spans([(0, "a", 1, 1)]).where(F.lit(False))).first()
    assert (row.total_requests, row.has_errors) == (0, False)


@pytest.mark.parametrize("score, band", [(3.0, "amber"), (3.1, "red"), (2.0, "blue")])
def test_anomaly_band(spark, score, band):
    assert spark.range(1).select(A.anomaly_band(F.lit(score)).alias("b")).first().b == band
