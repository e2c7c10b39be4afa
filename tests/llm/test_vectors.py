import math

import numpy as np
import pytest
from helpers import roots

from spanlake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vector string"


def plain(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(np.float32(v), float)
    links, n = [], dict.fromkeys(range(len(rows)), 0)
    for k, x in good.items():
        for m, y in good.items():
            if m < k and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links.append((rows[k][0], rows[m][0]))
                n[k] += 1
                n[m] += 1
    root = roots({i for i, _ in rows if i is not None}, links)
    return sorted(((i, n[k], root.get(i), root.get(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def cases():
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(300, 12))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, (base[k % 7] + rnd.normal(size=12) * 0.35).tolist()) for k in range(120)]
    rows += [(2000 + k, base[3].tolist()) for k in range(30)] + [(2100, (base[3] * 5).tolist())]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [nan] * 12), (3004, [inf] + [0.0] * 11),
             (3005, [None, 1.0]), (3006, [1.0, 0.0]), (3007, [2.0, 0.1]), (3008, [1.0]), (3009, [-1.0]), (3010, [3.0]),
             (3011, [-0.0, 1.0]), (3012, [0.0, 1.0]), (None, base[3].tolist()), (3013, [1e-30] * 12), (3014, [1e30] * 12)]
    return rows


@pytest.mark.parametrize("block,per_list", [(1024, 256), (16, 20)])
def test_as_all_pairs(spark, monkeypatch, block, per_list):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PER_LIST", per_list)
    rows = cases()
    frame = spark.createDataFrame([(*r, 0, 5, "x") for r in rows], SCHEMA).repartition(3)
    got = vectors.near_vectors(frame).collect()
    # A null id is no node, so other rows do not count it either.
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept or None if r.vec_id is None else r.kept) for r in got), key=str) \
        == sorted(((i, n, c, True if i is None else k) for i, n, c, k in plain(rows)), key=str)


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0, 1, "x"), (1, [1.0, 0.0], 0, 1, "x"), (2, [0.0, 1.0], 0, 1, "x")], SCHEMA)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()) == [
        (1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_visits_and_shortlist_lose_nothing():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1500, 10))
    x[700:] = x[rnd.integers(0, 700, 800)] + rnd.normal(size=(800, 10)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.fit(x, 20_000)
    home = vectors._nearest(x, index.centres)
    radius = math.sqrt(0.2)
    visits = [set(v.tolist()) for v in vectors.visited(index, x, home, radius)]
    codes, error = vectors.encode(index, x, home)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(a) > 300 and len(index.centres) > 20
    for i, j in zip(a.tolist(), b.tolist()):
        assert home[i] == home[j] or home[j] in visits[i] or home[i] in visits[j]
        assert len(vectors.shortlist(index, x[[i]], home[j], codes[[j]], (radius + error[[j]]) ** 2)[0]) == 1


def test_recall_in_many_dimensions(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(4000, 64))
    x[2000:] = x[rnd.integers(0, 2000, 2000)] + rnd.normal(size=(2000, 64)) * 0.47  # cosines around 0.9
    frame = spark.createDataFrame([(k, v.tolist(), 0, 1, "x") for k, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame).collect()}
    x = np.float32(x).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum() > 500


@pytest.mark.parametrize("rank, size, rows", [(4, 64, 3000), (8, 768, 3000), (16, 768, 3000), (64, 64, 3000), (400, 768, 2000)])
def test_recall_for_few_directions(spark, monkeypatch, rank, size, rows):
    """Vectors of so many independent directions, a third of them near copies."""
    monkeypatch.setattr(vectors, "PER_LIST", 100)
    rnd = np.random.default_rng(rank + size)
    base = rnd.normal(size=(rows, rank))
    third = rows // 3
    base[:third] = base[rnd.integers(third, rows, third)] + rnd.normal(size=(third, rank)) * 0.46
    x = np.float32(base @ rnd.normal(size=(rank, size))).astype(float)
    frame = spark.createDataFrame([(k, v.tolist(), 0, 1, "x") for k, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum() > 100


def test_exact_form_and_few_links(spark, monkeypatch):
    """Asked for, or with too few links to judge by, nothing is missed."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(900, 20))
    x[:200] = x[rnd.integers(300, 900, 200)] + rnd.normal(size=(200, 20)) * 0.4
    x = np.float32(x).astype(float)
    frame = spark.createDataFrame([(k, v.tolist(), 0, 1, "x") for k, v in enumerate(x)], SCHEMA)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    monkeypatch.setattr(vectors, "PER_LIST", 40)
    for exact, margin, pairs in ((True, 0.01, 1), (False, 0.01, 10**9)):
        monkeypatch.setattr(vectors, "MARGIN", margin)
        monkeypatch.setattr(vectors, "LEAST_PAIRS", pairs)
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame, exact=exact).collect()}
        assert [got[k] for k in range(900)] == want and sum(want) > 100


def test_workers_need_no_package(spark):
    """What goes to workers are arrays and functions by value."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle
    index = vectors.fit(np.eye(8), 10)
    raw = cloudpickle.dumps((vectors.encode, vectors.VectorIndex, vectors.visited))
    arrays = pickle.dumps((index.centres, index.books))
    code = ("import pickle, sys; f, V, v = pickle.loads(bytes.fromhex(sys.argv[1])); i = V(*pickle.loads(bytes.fromhex(sys.argv[2])));"
            "import numpy as np; print(f(i, np.eye(8), np.zeros(8, int))[0].shape)")
    done = subprocess.run([sys.executable, "-c", code, raw.hex(), arrays.hex()], cwd="/", capture_output=True, text=True,
                          env={"PATH": "/usr/bin"}, timeout=60)
    assert "(8, 2)" in done.stdout, done.stderr
