import numpy as np
import pytest
from helpers import crc, documents, prose
from pyspark.sql import functions as F

from spanlake.llm import language, quality

TONGUES = {"en": "the and of to in that with for this".split(), "fr": "le la des une dans pour avec être où".split(),
           "de": "der die und das nicht über für mit ein".split()}
CASES = [(9001, None), (9002, ""), (9003, "12 34 !?"), (9004, "é"), (9005, "x"), (None, "the and of")]


def tongue(name, seed, n=60):
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(TONGUES[name], n))


def language_docs(spark):
    rows = [(k, tongue(t, k), t, "s") for k, t in enumerate(list(TONGUES) * 30)]
    rows += [(d, t, None, "s") for d, t in CASES]
    rows += [(9010, tongue("en", 1, 80) + " " + tongue("de", 2, 40), None, "s"),
             (9011, tongue("fr", 3, 60_000), None, "s"), (3, tongue("en", 4), "en", "s"), (3, tongue("en", 4), "en", "s")]
    return documents(spark, rows)


def test_languages(spark):
    got = language.language_table(language_docs(spark)).collect()
    assert len(got) == 90 + len(CASES) + 4
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(list(TONGUES) * 30):
        if k != 3:
            assert by_id[k].lang_pred == t and 0 <= by_id[k].score <= 1
        assert by_id[k].held_out == (crc(k) % 3 == 1)
    assert [by_id[d].lang_pred == "und" for d, _ in CASES[:5]] == [True, True, True, False, False]
    assert by_id[9010].lang_set == ["de", "en"] and by_id[9010].lang_pred == "en"
    assert abs(by_id[9010].score - 2 / 3) < 0.1
    assert by_id[9011].lang_pred == "fr" and by_id[9011].lang_set == ["fr"]
    assert sum(r.doc_id == 3 for r in got) == 3


def test_shares_reach_the_best_likelihood():
    rnd = np.random.default_rng(1)
    prob = rnd.random((200, 2)).astype(np.float32) + 0.01
    share, reached = language._shares(prob, None)
    grid = max(float(np.log(prob @ np.array([p, 1 - p])).sum()) for p in np.linspace(0, 1, 1001))
    assert reached > grid - 0.05 and abs(share.sum() - 1) < 1e-4
    twice = language._shares(prob, np.full(200, 2.0, np.float32))
    assert np.allclose(twice[0], share, atol=1e-3)


def test_language_filter_and_empty_tables(spark):
    docs = language_docs(spark)
    model = language.fit(docs)
    kept = language.with_language(docs, model)
    assert kept.columns == docs.columns
    assert {9001, 9002, 9003}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() >= docs.count() - 5
    nothing = documents(spark, [])
    assert language.language_table(nothing).count() == 0
    assert [r.lang_pred for r in language.language_table(documents(spark, [(1, "abc", None, None)])).collect()] == ["und"]


def quality_docs(spark):
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        text = (" ".join([f"w{k}!!!"] * 40) if k % 8 == 0 else prose(k, 30).upper() + " ###") if bad else prose(k, 40 + k % 30) + "."
        rows.append((k, text, "en", "s"))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(d, t, None, None) for d, t in CASES] + [(5, prose(5, 40), "en", "s"), (9020, prose(9, 40_000), "en", "s")]
    labels += [(None, 1, 0), (7, None, 0), (8, 0, 0), (8, 0, 0), (777_777, 1, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_docs(spark)
    got = quality.quality_table(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
    right = [r.predicted == (0 if r.doc_id % 4 == 0 else 1) for r in got
             if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.95


def test_quality_without_labels(spark):
    docs, labels = quality_docs(spark)
    assert quality.quality_table(documents(spark, []), labels).count() == 0
    none = quality.quality_table(docs, labels.where("false")).collect()
    assert len({r.score for r in none}) == 1
    ones = quality.quality_table(docs, labels.where("quality = 1")).collect()
    assert {r.predicted for r in ones} == {1}


def test_features_do_not_depend_on_neighbours():
    texts = ["", "A b A b", prose(1, 40), "x\nx\nx", "###", "é É"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    together = quality.features(np.concatenate(raw), at)
    for k, one in enumerate(raw):
        assert np.allclose(together[k], quality.features(one, np.array([0, len(one)]))[0])


@pytest.mark.parametrize("seed", range(3))
def test_pairs_find_the_direction(seed):
    rnd = np.random.default_rng(seed)
    rows = rnd.normal(size=(400, len(quality.FEATURES)))
    labels = (rows[:, 2] + 0.1 * rnd.normal(size=400) > -0.5).astype(int)
    model = quality.fit_pairs(rows, labels)
    assert np.mean((model.score(rows) >= quality.CUT) == labels) > 0.95


def test_every_pair_counts():
    """The loss over all pairs is least at the weights, also if the rows are many more than any sample."""
    rnd = np.random.default_rng(4)
    rows = rnd.normal(size=(300, len(quality.FEATURES)))
    labels = (rows[:, 2] - rows[:, 5] + rnd.normal(size=300) > 0.3).astype(int)
    model = quality.fit_pairs(rows, labels)
    basis = quality._basis((rows - rows.mean(0)) / rows.std(0))
    gap = (basis[labels == 1][:, None] - basis[labels == 0][None]).reshape(-1, basis.shape[1])
    slope = gap.T @ (1 / (1 + np.exp(gap @ model.weights))) / len(gap) - quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-4
    assert np.isclose(model.threshold, np.quantile(basis @ model.weights, np.mean(labels == 0)), atol=1e-6)
    assert np.allclose(quality.fit_pairs(np.tile(rows, (80, 1)), np.tile(labels, 80)).weights, model.weights, atol=1e-3)


def test_all_labelled_rows_are_learned_from(spark):
    """More labelled rows than any former bound, in several partitions: as if all rows were in one place."""
    n = 24_000
    noise = [((F.xxhash64("id", F.lit(k)) % 1000) / 1000.0).alias(f) for k, f in enumerate(quality.FEATURES)]
    measured = spark.range(n).select(F.col("id").alias("doc_id"), *noise).repartition(5)
    label = (F.col("letters") + (F.xxhash64("doc_id", F.lit(99)) % 1000) / 1000.0 > 0.2).cast("int").alias("quality")
    model = quality.fit(measured, measured.select("doc_id", label))
    kept = measured.select("*", label).where(~language.held_out(F.col("doc_id"), 2, 4)).toPandas()
    whole = quality.fit_pairs(kept[list(quality.FEATURES)].to_numpy(), kept.quality.to_numpy())
    assert len(kept) < n and np.allclose(model.centre, whole.centre) and np.allclose(model.weights, whole.weights, atol=1e-6)
    assert np.isclose(model.threshold, whole.threshold, atol=1e-6)
