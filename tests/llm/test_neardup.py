import random

import numpy as np
import pytest
from helpers import documents, prose, roots, words_of

from spanlake.llm import neardup
from spanlake.llm.components import components


def changed(text, seed, share):
    rnd = random.Random(seed)
    return " ".join(f"x{rnd.randint(0, 9999)}" if rnd.random() < share else w for w in text.split())


def cases():
    rows = [(k, prose(k, 30 + k)) for k in range(20)]
    rows += [(100 + k, changed(prose(1, 200), k, 0.01 * (k % 8))) for k in range(40)]  # a group of unequal copies
    rows += [(200 + k, prose(500, 60)) for k in range(5)] + [(206, prose(500, 60).upper())]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "two one"),
             (307, "a b a b a b"), (308, "a b a"), (None, prose(500, 60)), (None, "no id"),
             (400, prose(7, 30_000)), (401, changed(prose(7, 30_000), 1, 0.02)), (1, prose(1, 31)), (1, prose(1, 31))]
    rows += [(500, prose(500, 60)), (500, prose(8, 38))]  # an id with two texts links both
    return rows


def plain(rows, n, percent):
    def shingles(text):
        w = words_of(text)
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = roots({d for d, _ in rows if d is not None}, links)
    return sorted(((d, len(s), root.get(d), root.get(d) == d) for d, s in sets), key=str)


def table(spark, rows):
    return documents(spark, [(d, t, "en", "s") for d, t in rows]).repartition(3)


@pytest.mark.parametrize("n,percent", [(2, 80), (5, 80)])
def test_as_all_pairs(spark, n, percent):
    got = neardup.near_duplicates(table(spark, cases()), n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == plain(cases(), n, percent)


def test_filter_keeps_one_of_each(spark):
    docs = table(spark, cases())
    kept = neardup.without_duplicates(docs, 2, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = [d for d, _, c, k in plain(cases(), 2, 80) if k and d is not None]
    assert sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 2


def test_empty(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.without_duplicates(documents(spark, [])).count() == 0


def test_keys_meet_within_the_distance():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 16, (200, neardup.SLOTS)).astype(np.uint16)
    other = base.copy()
    for row in other:
        at = rnd.choice(neardup.SLOTS, rnd.integers(0, neardup.MOST_APART + 1), replace=False)
        row[at] ^= rnd.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert (neardup.join_keys(base)[0] == neardup.join_keys(other)[0]).any(1).all()


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rnd = random.Random(seed)
    nodes = rnd.sample(range(1000), 60)
    links = [(nodes[k], nodes[k + 1]) for k in range(25)] if seed == 0 else [
        (rnd.choice(nodes), rnd.choice(nodes)) for _ in range(15 * seed)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in links)}


def test_a_pair_meets_once_a_chunk():
    """Of the keys that two signatures share, one of each chunk has nothing left out before in common."""
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 3, (400, neardup.SLOTS)).astype(np.uint16)
    other = np.where(rnd.random(base.shape) < 0.3, base + 1, base).astype(np.uint16)
    one, two = neardup.join_keys(base), neardup.join_keys(other)
    same = one[0] == two[0]
    first = same & np.all([(x < 0) | (x != y) for x, y in zip(one[1:], two[1:])], axis=0)
    per = same.shape[1] // neardup.CHUNKS
    for chunk in range(neardup.CHUNKS):
        part = slice(chunk * per, (chunk + 1) * per)
        assert (first[:, part].sum(1) == same[:, part].any(1)).all()


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_made_to_collide(spark):
    word = thue_morse(2048)
    mirror = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x"), (2, f"{mirror} x"), (3, f"{word} x"), (4, f"{word[:1024]} y"), (5, f"{mirror[:1024]} y")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, rows), 2, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
