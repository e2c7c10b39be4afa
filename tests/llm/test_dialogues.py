import hashlib
import itertools
import random
import re

import duckdb
import pytest
from check_sql import differences
from hypothesis import given, settings, strategies as st

from spanlake.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, n long, fault string, phase string"


def conversations(spark, rows):
    """Rows (conv_id, turn, role, text) beside columns that clash with inner names."""
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def every_repair(shape, most_inserts):
    """(cost, audit) of all ways to edit rows of these codes into a well-formed conversation."""
    for letters in itertools.product("KRD", repeat=len(shape)):
        if any(code == dialogues.GONE and x != "D" for code, x in zip(shape, letters)):
            continue
        fixed = sum({"K": 0, "R": 2, "D": 3}[x] + (x != "D" and code != dialogues.GONE and code % 2)
                    for code, x in zip(shape, letters))
        for holes in itertools.product(range(most_inserts + 1), repeat=len(shape) + 1):
            if sum(holes) > most_inserts:
                continue
            audit = "I" * holes[0] + "".join(x + "I" * h for x, h in zip(letters, holes[1:]))
            rows, options = iter(zip(shape, letters)), []
            for x in audit:
                if x == "I":
                    options.append("ua")
                    continue
                code, letter = next(rows)
                options.append([""] if letter == "D" else "ua" if letter == "R"
                               else [dialogues.INITIALS[code // 2]])
            if any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*options)):
                yield fixed + 2 * sum(holes), audit


def test_lightest_of_all_repairs():
    for length in range(4):
        for shape in itertools.product(range(dialogues.GONE + 1), repeat=length):
            if length == 3 and random.Random(str(shape)).random() > 0.25:
                continue
            assert dialogues.lightest_repair(bytes(shape)) == min(every_repair(shape, 3)), shape


def plain_repair(shape):
    """The same by a table over rows and states."""
    best = {0: (0, "")}

    def opened(best):
        best = dict(best)
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                to = dialogues.DUE[state]
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    for code in shape:
        after = {}
        for state, (cost, audit) in opened(best).items():
            table = {state: [(state, 3, "D")]} if code == dialogues.GONE else dialogues.ROWS[code]
            for to, price, letter in table[state]:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, audit + letter))
        best = after
    ends = opened(best)
    return min(ends[s] for s in (0, 3) if s in ends)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0, 2, 2, 3, 4, 4, 5, 6, 8, 10, 10, 10]), max_size=400), st.integers(2, 5))
def test_segments_change_nothing(shape, segment):
    before = dialogues.SEGMENT
    dialogues.SEGMENT = segment
    try:
        assert dialogues.lightest_repair(bytes(shape)) == plain_repair(shape)
    finally:
        dialogues.SEGMENT = before


def test_long_conversation_is_quick():
    rnd = random.Random(5)
    shape = bytes(rnd.choice([0, 2, 2, 3, 4, 5, 10]) for _ in range(60_000))
    cost, audit = dialogues.lightest_repair(shape)
    assert len(audit) == 60_000 + audit.count("I") and cost == plain_repair(shape[:60_000])[0]


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there!"), (1, 2, "assistant", "Hello."),
    (2, None, "user", "first?"), (2, 3, None, None), (2, 3, "assistant", ""), (2, 9, "assistant", "no end"),
    (3, 5, "user", "Same."), (3, 5, "user", "Same."), (3, 7, "user", "Same."), (3, 8, "assistant", "x" * 300_000 + "."),
    (None, 1, "user", "Nobody's."), (None, None, None, None),
    (4, None, None, " \t\r\n"), (5, 2, "", "Empty role."), (5, 3, "User", "Upper."), (6, -4, "tool", "a\nb ? \x85"),
    (7, 1, "user", "\x1c."), (7, 2, "assistant", "Ünïcödé ?"), (8, 1, "assistant", "b."), (8, 1, "assistant", "a."),
]


@pytest.mark.parametrize("more", [[], [(100 + c, t, r, f"{r} {t}{'.' if t % 3 else ''}") for c in range(60)
                                       for t, r in enumerate(random.Random(c).choices(["user", "assistant", "system", "u"], k=c % 9))]])
def test_equals_sql(spark, more):
    df = conversations(spark, ROWS + more)
    ours = dialogues.repairs_table(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert differences(ours, con.execute(dialogues.REPAIRS_SQL).df()) is None


def test_tables_without_rows(spark):
    assert dialogues.repairs_table(conversations(spark, [])).count() == 0
    gone = spark.createDataFrame([(1, 1, "", "", 0)], "conv_id long, turn long, role string, text string, n long")
    row = dialogues.repaired(gone).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_many_equal_rows_are_one(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 5000), (1, 2, "assistant", "Yes.", 1)],
                                 "conv_id long, turn long, role string, text string, n long")
    row = dialogues.repaired(rows).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (4999, 4999, 3 * 4999, "K" + "D" * 4999 + "K")
    assert row.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
