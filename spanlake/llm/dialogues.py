"""Repair of damaged conversations by Knuth's lightest-derivation agenda.

A well-formed conversation is an optional system turn and then pairs of a user and an assistant turn.  Its
damaged rows are kept, given another role, deleted, or joined by empty turns; each edit has a price, and the
cheapest sequence of edits is wanted, of equal ones the least in text order.

Repair is deduction over weighted items.  The item ``(k, state)`` says that the first ``k`` units of a
conversation have been turned into a beginning of a well-formed one; a unit is a row, or a run of rows that must
go.  Each hyperedge joins an item with a unit's own derivation, or adds an empty turn, and its weight, the pair
(cost, audit), is the sum of costs and the joined audits: never less than the item it starts from, and rising with
it.  So items leave the agenda in order of weight, each with its lightest derivation, and the first goal item that
leaves it is the answer.  Long conversations are derived in segments of SEGMENT units whose items hold the lightest
derivation between every two states, level upon level, so audits are joined a few times and not once a row.

A conversation streams through one task, twice in one sorted pass: first its rows without texts, which the agenda
needs, then the texts of rows that may stay, which only go through a hash.  A task therefore holds a byte or two
a row and never a text beyond its batch.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .sqltext import crc32_sql

#: Prices of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SEGMENT = 64
#: Short conversations of one shape are derived once per worker; the longest shape kept, and how many.
KEPT_UNITS, KEPT_SHAPES = 64, 50_000

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads, whichever is due; a conversation may end in START or ASSISTANT.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT},
        "": {s: s for s in range(4)}, "x": {}}
INITIALS = ["s", "u", "a", "", "x"]
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Unit of a row that must go; other units are 2 * initial + (1 if truncated).
GONE = 2 * len(INITIALS)

Table = dict[int, list[tuple[int, int, str]]]


def _row_table(initial: str, cut: bool) -> Table:
    """From each state: where each edit of one row leads, its cost and its letter."""
    more = TRUNCATED * cut
    table: Table = {}
    for state in range(4):
        edits = [(state, DELETE, "D"), (DUE[state], REROLE + more, "R")]
        if state in KEEP[initial]:
            edits.append((KEEP[initial][state], more, "K"))
        table[state] = edits
    return table


ROWS = [_row_table(initial, cut) for initial in INITIALS for cut in (False, True)]


def _units(shape: bytes) -> list[Table]:
    """Derivations of each row and of each run of rows that must go."""
    units = []
    for code, run in groupby(shape):
        n = sum(1 for _ in run)
        if code == GONE:  # an empty turn before a deletion is never the least of equal audits
            units.append({s: [(s, DELETE * n, "D" * n)] for s in range(4)})
        else:
            units += [ROWS[code]] * n
    return units


def _agenda(units: list[Table], start: int, to_goal: bool) -> list[tuple[int, int, str]]:
    """Lightest derivations over all units from ``start``: ``(state, cost, audit)``.

    With ``to_goal`` only the lightest that ends in a well-formed conversation, and empty turns may follow the
    last unit; without it one for each state that can be reached, and empty turns stand before units only.
    """
    agenda, final, ends = [(0, "", 0, start)], set(), []
    while agenda:
        cost, audit, k, state = heapq.heappop(agenda)
        if (k, state) in final:
            continue
        final.add((k, state))
        if k == len(units):
            if not to_goal:
                ends.append((state, cost, audit))
                continue
            if state in (START, ASSISTANT):
                return [(state, cost, audit)]
        else:
            for after, price, letters in units[k][state]:
                if (k + 1, after) not in final:
                    heapq.heappush(agenda, (cost + price, audit + letters, k + 1, after))
        if (k, DUE[state]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", k, DUE[state]))
    return ends


def lightest_repair(shape: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows of these codes, the least audit of equal ones."""
    units = _units(shape)
    while len(units) > SEGMENT:
        units = [{s: _agenda(units[k:k + SEGMENT], s, False) for s in range(4)}
                 for k in range(0, len(units), SEGMENT)]
    return _agenda(units, START, True)[0][1:]


def _script(shape: bytes, audit: str) -> tuple[list[tuple[str, str | None]], str]:
    """For each row that need not go: the lines to put before it, and its role ("" as it is, None deleted);
    the lines after the last row."""
    state, at, lines, script = START, 0, "", []
    for code in shape:
        while audit[at] == "I":
            state, at = DUE[state], at + 1
            lines += f"\n{NAMES[state]}:"
        letter, at = audit[at], at + 1
        if code == GONE:
            continue
        if letter == "D":
            script.append((lines, None))
        else:
            state = DUE[state] if letter == "R" else KEEP[INITIALS[code // 2]][state]
            script.append((lines, NAMES[state] if letter == "R" else ""))
        lines = ""
    for _ in audit[at:]:
        state = DUE[state]
        lines += f"\n{NAMES[state]}:"
    return script, lines


REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired_sha256 string")
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """One conversation while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.shape, self.counts, self.illegal = conv_id, bytearray(), [0, 0, 0, 0], 0
        self.turns, self.least, self.most, self.last_initial = 0, None, None, None
        self.audit = self.script = None

    def row(self, turn, role: str, n: int, fault: int) -> None:
        """``n`` equal rows, without their text."""
        if n == 0:
            return
        if turn is not None:
            if self.most != turn:
                self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        initial = role[:1]
        self.illegal += n - 1
        if self.last_initial is not None and self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        again = BLANK if fault == BLANK else DUPLICATE
        self.counts[fault] += 1
        self.counts[again] += n - 1
        live = fault in (SOUND, CUT)
        if live:
            self.shape.append(2 * INITIALS.index(initial if initial in KEEP else "x") + (fault == CUT))
        self.shape += bytes([GONE]) * (n - live)

    def derive(self, known: dict) -> None:
        """Run the agenda; ``known`` holds the repairs of short shapes."""
        shape = bytes(self.shape)
        got = known.get(shape)
        if got is None:
            got = lightest_repair(shape)
            if len(shape) <= KEPT_UNITS and len(known) < KEPT_SHAPES:
                known[shape] = got
        self.cost, self.audit = got
        script, self.tail = _script(shape, self.audit)
        self.script, self.hash, self.lines = iter(script), hashlib.sha256(), 0

    def _put(self, lines: str) -> None:
        """Hash whole lines, each after a newline but for the first of all."""
        if lines:
            self.hash.update((lines if self.lines else lines[1:]).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def text(self, role: str, text: str) -> None:
        """The text of the next row that need not go."""
        before, new = next(self.script)
        self._put(before)
        if new is not None:
            self._put(f"\n{new or role}:{text}")

    def result(self, known: dict) -> tuple:
        if self.script is None:
            self.derive(known)
        self._put(self.tail)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come in order, first all without and then some with text."""
    now, known, done = None, {}, []

    def flushed():
        columns = list(zip(*done))
        done.clear()
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [c.split()[0] for c in REPAIRED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for conv_id, phase, turn, role, text, n, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result(known))
                now = _Conversation(conv_id)
            if phase == 0:
                now.row(turn, role, n, fault)
            else:
                if now.script is None:
                    now.derive(known)
                now.text(role, text)
        if done:
            yield flushed()
    if now is not None:
        done.append(now.result(known))
        yield flushed()


def _code() -> Column:
    """What happens to a row, 0 to 19, by its conversation and turn; null reads as one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return F.crc32(name) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows after damage, ``n`` equal ones as one; 0 copies of a dropped row.

    Null role and text become one space.  Code 0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?``
    away, 3 repeats it, 4 makes it the user's.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), _code().alias("d"))
    text = (F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("d") == 0, "").when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("n"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, and the cheapest repair, of every conversation of ``conv_id, turn, role, text, n``.

    ``n`` is the number of equal rows, 0 for a conversation's row that is not there any more; a conversation with
    such rows only has zeros, an empty audit and the hash of an empty text.  Rows go by turn, null first; rows of
    one turn by role and the text's SHA-256, equal rows one after the other.  A null ``conv_id`` is a conversation
    of its own.  An empty role has an empty initial, which no rule forbids to keep.  Texts of any length only go
    through a hash; other columns, whatever their names, are not read; no rows give no rows.
    """
    white = "\\x20\\x09-\\x0D"
    marked = rows.select("conv_id", "turn", "role", "text", "n", F.sha2("text", 256).alias("mark"))
    seen = Window.partitionBy("conv_id", "role", "mark").orderBy((F.col("n") == 0).cast("int"), F.col("turn"))
    fault = (F.when(~F.col("text").rlike(f"[^{white}]"), BLANK)
             .when(F.row_number().over(seen) > 1, DUPLICATE)
             .when(~F.col("text").rlike(f"[.!?][{white}]*\\z"), CUT).otherwise(SOUND))
    faulty = marked.withColumn("fault", fault)
    shapes = faulty.withColumn("text", F.lit(None).cast("string")).withColumn("phase", F.lit(0))
    texts = faulty.where(F.col("fault").isin(SOUND, CUT) & (F.col("n") > 0)).withColumn("phase", F.lit(1))
    return (shapes.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions("conv_id", "phase", "turn", "role", "mark")
            .select("conv_id", "phase", "turn", "role", "text", "n", "fault")
            .mapInArrow(_repair_stream, REPAIRED))


def repairs_table(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: damage it by rule, then repair it.

    Every conversation comes back, also one that the damage leaves without rows.  Nulls, ties, repeated rows,
    empty and very long texts, other columns and empty tables are as for :func:`damaged` and :func:`repaired`.
    """
    return repaired(damaged(conversations))


def _least(*weights: str) -> str:
    return f"list_sort([{', '.join(weights)}])[1]"


def _edit(weight: str, cost: str, letter: str, line: str | None) -> str:
    """SQL of a weight after one more edit."""
    text = f"{weight}.r" if line is None else f"list_append({weight}.r, {line})"
    return f"{{'c': {weight}.c + {cost}, 'a': {weight}.a || '{letter}', 'r': {text}}}"


def _repairs_sql() -> str:
    never = "{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    nothing = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    user, assistant = "'user:'", "'assistant:'"

    def insert(weight: str, line: str) -> str:
        return _edit(weight, str(INSERT), "I", line)

    def gone(state: int) -> str:
        return _edit(f"e.w{state}", str(DELETE), "D", None)

    def changed(state: int, role: str) -> str:
        return _edit(f"e.w{state}", f"{REROLE} + t.cut", "R", f"'{role}:' || t.text")

    def kept(state: int, initial: str) -> str:
        same = _edit(f"e.w{state}", "t.cut", "K", "t.role || ':' || t.text")
        return f"CASE WHEN substr(t.role, 1, 1) = '{initial}' THEN {same} ELSE {never} END"

    def step(state: int, ways: list[str]) -> str:
        best = _least(gone(state), kept(state, ""), *ways)
        return f"CASE WHEN t.fault IN (1, 2) THEN {gone(state)} ELSE {best} END AS w{state}"

    steps = ", ".join([
        step(0, []), step(1, [kept(0, "s")]),
        step(2, [f(s, x) for s in (0, 1, 3) for f, x in ((kept, "u"), (changed, "user"))]),
        step(3, [kept(2, "a"), changed(2, "assistant")])])

    def opened(table: str) -> str:
        """SQL of the weights of ``table`` with up to two empty turns more."""
        once = (f"SELECT *, {_least('w2', insert('w0', user), insert('w1', user), insert('w3', user))} AS x2, "
                f"{_least('w3', insert('w2', assistant))} AS x3 FROM {table}")
        return (f"SELECT conv_id, k, w0, w1, {_least('x2', insert('x3', user))} AS w2, "
                f"{_least('x3', insert('x2', assistant))} AS w3 FROM ({once})")

    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    white = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS d FROM conversations),
left_over AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM left_over),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 1 WHEN again > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][{white}]*$') THEN 3 ELSE 0 END AS fault FROM placed),
t AS (SELECT *, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS cut FROM faulty),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
w AS (
  SELECT conv_id, 0::BIGINT AS k, {nothing} AS w0, {never} AS w1, {never} AS w2, {never} AS w3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT e.conv_id, e.k + 1, {steps}
  FROM ({opened('w')}) e JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.k = e.k + 1),
ended AS (
  SELECT w.conv_id, {_least('w.w0', 'w.w3')} AS best
  FROM ({opened('w')}) w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = coalesce(c.n, 0))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


REPAIRS_SQL = _repairs_sql()
