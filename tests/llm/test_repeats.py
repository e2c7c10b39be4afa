import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents, prose

from spanlake.llm import repeats


def plain(rows, length, keep_first):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by looking at every window."""
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0, k))
    seen = defaultdict(list)
    for k in order:
        raw = texts[k][1]
        for i in range(len(raw) - length + 1):
            seen[raw[i:i + length]].append((k, i))
    gone = [np.zeros(len(raw), bool) for _, raw in texts]
    for places in seen.values():
        for k, i in places[1:] if keep_first else places if len(places) > 1 else []:
            gone[k][i:i + length] = True
    out = []
    for (d, raw), g in zip(texts, gone):
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.append((d, len(raw), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~g])).hexdigest()))
    return sorted(out, key=str)


def cases():
    shared, other = prose(1, 90), prose(2, 90)
    rows = [(k, prose(10 + k, 40) + " " + shared[:350 + 20 * k] + prose(50 + k, 30)) for k in range(12)]
    rows += [(20, other + " é " + other), (21, other[5:]), (22, "ab" * 700), (23, "ab" * 300 + prose(3, 20)),
             (24, "x" * 1500), (25, None), (26, ""), (27, "short"), (28, "short"), (None, prose(4, 100) + other),
             (30, prose(5, 80)), (31, prose(5, 80)), (40, prose(6, 500) + shared + prose(7, 500) + shared)]
    return rows


def table(spark, rows):
    return documents(spark, [(d, t, "en", "s") for d, t in rows]).repartition(3)


def collected(found):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=str)


@pytest.mark.parametrize("pieces", [10_000, 1])
def test_all_copies_go(spark, monkeypatch, pieces):
    monkeypatch.setattr(repeats, "ORDER_PIECES", pieces)  # 1: every crowd by hashes of windows
    rows = cases() + [(50, prose(8, 100)), (50, prose(8, 100)), (51, prose(9, 80)), (51, prose(9, 80) + "!")]
    assert collected(repeats.repeats_table(table(spark, rows))) == plain(rows, repeats.LENGTH, False)


@pytest.mark.parametrize("pieces", [10_000, 1])
def test_first_copy_stays(spark, monkeypatch, pieces):
    monkeypatch.setattr(repeats, "ORDER_PIECES", pieces)
    rows = cases()
    found = repeats.find_repeats(table(spark, rows), keep_first=True)
    assert collected(found) == plain(rows, repeats.LENGTH, True)


def test_text_longer_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RUN", 700)
    rows = [(1, prose(1, 600)), (2, prose(2, 300) + prose(1, 600)[900:2400]), (3, prose(3, 50))]
    assert collected(repeats.repeats_table(table(spark, rows))) == plain(rows, repeats.LENGTH, False)


def test_passages_of_over_fifty_words(spark):
    """A repeated passage goes wholly from LENGTH bytes on and stays below, whatever its words; clean texts stay."""
    rows, gone = [(k, prose(500 + k, 150)) for k in range(8)], dict.fromkeys(range(8), 0)
    for size in (repeats.LENGTH - 1, repeats.LENGTH, repeats.LENGTH + 1, 2 * repeats.LENGTH):
        passage = prose(size, 200).replace("é", "e").replace("ñ", "n")[:size]
        assert len(passage.encode()) == size and len(passage.split()) > 50
        for side in "AB":
            rows.append((len(rows), prose(600 + len(rows), 70) + side + passage + side + prose(700 + len(rows), 70)))
            gone[rows[-1][0]] = size if size >= repeats.LENGTH else 0
    got = repeats.repeats_table(table(spark, rows))
    assert {r.doc_id: r.n_removed for r in got.collect()} == gone
    assert collected(got) == plain(rows, repeats.LENGTH, False)


def test_empty(spark):
    assert repeats.repeats_table(documents(spark, [])).count() == 0


@pytest.mark.parametrize("letters, length", [(2, 13), (2, 40), (1, 20), (4, 8), (3, 30)])
def test_longest_previous_factors(letters, length):
    rnd = np.random.default_rng(letters + length)
    texts = [bytes(rnd.integers(0, letters, n).astype(np.uint8)) for n in (90, 41, 60, 5)]
    texts.append(texts[0][:70])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]
    starts = np.array([begin[k] + i for k, i in places])
    got = repeats.longest_previous_factors(data, starts, length)

    def common(one, two):
        x, y = (texts[k][i:i + length] for k, i in (one, two))
        return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    for n, here in enumerate(places):
        assert got[0][n] == max((common(here, p) for p in places[:n]), default=0)
        assert got[1][n] == max((common(here, p) for p in places[n + 1:]), default=0)


def test_one_id_with_many_texts(spark):
    """Texts of null or equal ids are told apart."""
    shared = prose(1, 90)
    rows = [(None if k % 2 else 7, prose(100 + k, 10) + shared + prose(200 + k, 10)) for k in range(40)]
    got = repeats.repeats_table(table(spark, rows))
    assert collected(got) == plain(rows, repeats.LENGTH, False)
    assert {(r.n_kept, r.repeats) for r in got.collect()} == {(r.n_bytes - r.n_removed, True) for r in got.collect()}
