import random

import numpy as np
import pytest
from helpers import documents, prose

from spanlake.llm import decontaminate as D


def edited(text, seed, edits):
    rnd, chars = random.Random(seed), list(text)
    for _ in range(edits):
        at, kind = rnd.randrange(len(chars)), rnd.random()
        if kind < 0.4:
            chars[at] = rnd.choice("qxzé")
        elif kind < 0.7:
            chars.insert(at, rnd.choice("qxzé"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def least_edits(item, text):
    """Least edits of the item against any part of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for k, c in enumerate(item, 1):
        diagonal = row[:-1] + np.array([c != x for x in text], int)
        new = np.r_[k, np.minimum(diagonal, row[1:] + 1)]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def tables():
    items = [(k, prose(900 + k, 12 + 4 * k)) for k in range(8)] + [(20, None), (21, " "), (22, "tiny"), (23, prose(900, 12))]
    docs = []
    for k in range(60):
        item = D.normal(items[k % 8][1])
        text = prose(k, 40)
        if k % 3:
            text += " " + edited(item, k, k % 3 * D.edit_budget(len(item)) * (k % 5) // 4) + " " + prose(k + 99, 10)
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "a TINY\n thing"), (103, "tinytiny"), (104, items[0][1].upper().replace(" ", " \n ")),
             (105, prose(3, 20_000) + items[3][1]), (106, "the " * 3000), (104, "other"), (None, items[1][1]),
             (107, items[2][1]), (108, items[2][1][1:])]
    return docs, items


def plain(docs, items):
    out = set()
    for d, t in docs:
        text = D.normal(t)
        for i, item in items:
            item = D.normal(item)
            if len(item) < D.Q:
                if item and f" {item} " in f" {text} ":
                    out.add((d, i, 0))
            elif len(text) < 50_000 and (e := least_edits(item, text)) <= D.edit_budget(len(item)):
                out.add((d, i, e))
            elif len(text) >= 50_000 and item in text:
                out.add((d, i, 0))
    return out


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 300])
def test_as_full_alignment(spark, block):
    docs, items = tables()
    got = D.benchmark_matches(documents(spark, [(d, t, "en", "s") for d, t in docs]).repartition(2),
                              spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"), block)
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == plain(docs, items)


def test_filter(spark):
    docs, items = tables()
    rows = documents(spark, [(d, t, "en", "s") for d, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.without_matches(rows, bench, 300)
    gone = {d for d, _, _ in plain(docs, items)}
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([d for d, _ in docs if d not in gone] + [104])


def test_empty(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = documents(spark, [(d, t, "en", "s") for d, t in docs])
    assert D.contaminated(documents(spark, []), bench).count() == 0
    assert D.contaminated(rows, bench.where("false")).count() == 0
    assert D.without_matches(rows, bench.where("false")).count() == len(docs)
