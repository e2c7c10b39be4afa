import hashlib
import random
import zlib

import duckdb
import pytest
from check_sql import differences

from spanlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, key string, depth string, part int"


def conversations(spark, rows):
    """Rows (conv_id, turn, role, text) beside columns that clash with inner names."""
    return spark.createDataFrame([(*r, "x", 3, "k", "d", 8) for r in rows], SCHEMA)


def plain(rows):
    """Nodes of the trie by dictionaries, as sorted tuples."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "",
                                                hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, d == len(turns)))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        out.append((min(c for c, _ in members), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(members),
                    sum(len(q) == len(p) + 1 for q in below),
                    sum(not any(x[:len(q)] == q and len(x) > len(q) for x in below) for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(str(c) for c, end in sorted(members) if end).encode()).hexdigest()))
    return sorted(out, key=str)


def dialogue(seed, n):
    rnd = random.Random(seed)
    return [("user" if k % 2 else "assistant", rnd.choice(["yes", "no é", "", "x" * 40])) for k in range(n)]


ROWS = [
    (0, None, "system", "Be kind."), (0, 1, None, "Hi."), (0, 2, "assistant", None), (0, 3, "user", ""),
    (7, 1, "user", "Hi."), (7, 1, "user", "Hi."), (7, 5, "assistant", "y" * 200_000),
    (None, 1, "user", "nobody"), (250, 1, "user", "no base"), (-150, 1, "user", "a"), (-100, 1, "user", "b"),
    (-100, 2, "assistant", "\U0001f600ä"), (99, 0, None, None), (10_200, 1, "user", "a"), (10_207, 4, "user", "b"),
]
ROWS += [(1000 + c, t, *x) for c in range(140) for t, x in enumerate(dialogue(c % 9, c % 12))]


@pytest.mark.parametrize("deep, run", [(500_000, 10_000), (0, 7), (300, 1000)])
def test_equals_plain_form(spark, monkeypatch, deep, run):
    monkeypatch.setattr(trie, "DEEP_TURNS", deep)
    monkeypatch.setattr(trie, "IDS_AT_ONCE", run)
    got = trie.trie_table(conversations(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)


def test_equals_sql(spark):
    df = conversations(spark, ROWS)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert differences(trie.trie_table(df).toPandas(), con.execute(trie.TRIE_SQL).df()) is None


def test_one_conversation_of_many_turns(spark):
    rows = [(100, t, "user", f"turn {t}") for t in range(3000)]
    got = {r.depth: r for r in trie.trie_table(conversations(spark, rows)).collect()}
    assert len(got) == 3001 and all(r.n_leaves == r.n_convs == 1 for r in got.values())


def test_empty_table(spark):
    assert trie.trie_table(conversations(spark, [])).count() == 0
    assert trie.trie_table(conversations(spark, [(None, 1, "user", "x")])).count() == 0
