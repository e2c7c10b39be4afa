"""Small tables and plain re-statements of the operators for the tests."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(folded)


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    parts = "the an on re in tion ed er és ñar th of de la und sch".split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


DOCS = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, "
        "component string, part int")


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns that clash with inner names."""
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), False, 7, "x", 3) for r in rows], DOCS)


def roots(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            for x in (a, b):
                if least[x] != low:
                    least[x], changed = low, True
    return least
