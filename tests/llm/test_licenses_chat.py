import random
import re

import duckdb
from check_sql import differences
from helpers import documents, prose

from spanlake.llm import chat, licenses


def plain(text):
    """Licenses whose template's shingles lie densely enough somewhere in the text."""
    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return [tuple(w[k:k + 5]) for k in range(len(w) - 4)]

    own, found = grams(text), {}
    for name, template in licenses.TEMPLATES:
        want = set(grams(template))
        best = max((len(want & set(own[k:k + len(want)])) / len(want) for k in range(len(own))), default=0)
        if best >= licenses.CONTAINMENT:
            found[name] = max(found.get(name, 0), best)
    return found


def test_licenses(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(len(licenses.TEMPLATES) * 4):
        name, template = licenses.TEMPLATES[k // 4]
        words = template.split()
        if k % 4 == 1:
            words[-1] += " x"
        elif k % 4 == 2:
            words = [w.upper() for w in words]
        elif k % 4 == 3:
            words[rnd.randrange(len(words))] = "other"
        rows.append((k, prose(k, rnd.randint(0, 90)) + "\n" + " ".join(words) + ".\n" + prose(k + 500, rnd.randint(0, 90))))
    rows += [(900, None), (901, ""), (902, "MIT License"), (903, prose(1, 40_000) + " Released under the MIT License"),
             (None, "Licensed under CC BY 4.0"), (0, rows[0][1]), (904, "Released under the MIT License. " * 3)]
    got = licenses.license_matches(documents(spark, [(d, t, "en", "s") for d, t in rows])).collect()
    texts = {d: t for d, t in rows}
    assert len({(r.doc_id, r.license) for r in got}) == len(got) - 1  # doc 0 stands twice
    for d, text in texts.items():
        want = {name: share for name, share in plain(text).items()}
        ours = {r.license: r for r in got if r.doc_id == d}
        assert set(ours) <= set(want) and bool(ours) == bool(want), (d, set(ours), want)
        best = max(want.values(), default=0)
        assert all(abs(r.containment - want[n]) < 1e-9 for n, r in ours.items())
        assert not ours or max(r.containment for r in ours.values()) == best
    r = next(r for r in got if r.doc_id == 903)
    assert texts[903].encode()[r.start:r.end] == b"Released under the MIT License"
    assert licenses.license_matches(documents(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, perspective int, place string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


CHATS = ([(k, t, r, f"{r} says {t} é") for k in range(5) for t, r in enumerate(["system", "user", "assistant", "user", "ann"][:k + 1])]
         + [(10, 1, "a", "x"), (10, 1, "a", "x"), (10, 1, "b", None), (10, None, "b", "first"), (10, 2, None, "who"),
            (None, 0, "a", "no id"), (None, 1, "b", "<|assistant|>\n"), (11, 0, "system", "alone"), (12, 3, "a<|b", "")]
         + [(13, t, "ab"[t % 2], "w" * (t % 7)) for t in range(700)])


def test_perspectives_read_as_dialogues(spark):
    got = {}
    for r in chat.perspectives(turns(spark, CHATS)).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    people = {(c, role) for c, _, role, _ in CHATS if role not in (None, "system")}
    assert set(got) == people
    for (conv, who), rows in got.items():
        rows.sort(key=lambda r: r.place)
        whole = "".join(r.segment for r in rows)
        assert [r.place for r in rows] == list(range(sum(c == conv for c, *_ in CHATS)))
        for r in rows:
            assert whole[r.start:r.end] == r.segment
            mine = r.rendered_role == "assistant"
            assert (r.mask_start is not None) == mine
            if mine:
                assert whole[r.mask_start:r.mask_end].endswith("<|end|>") and whole[r.start:r.mask_start] == "<|assistant|>\n"
        assert whole.count("<|assistant|>") == sum(c == conv and role == who for c, _, role, _ in CHATS)


def test_perspectives_as_sql(spark, tmp_path):
    turns(spark, CHATS).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert differences(chat.perspectives(turns(spark, CHATS)).toPandas(), con.execute(chat.PERSPECTIVES_SQL).df()) is None
    assert chat.perspectives(turns(spark, [])).count() == 0
