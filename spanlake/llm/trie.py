"""The prefix trie of conversations by truncation peeling.

Conversations are peeled from the deepest turn on: at each depth the conversations that end there meet the nodes
that survive from the depth below, equal ones become one node, every node passes its counts on, loses its last
turn, and the next depth begins.  Each node is discovered when it is first reached, with all sums of its subtree
complete, so one descent gives nodes and sums together.

A conversation is one binary row, its path: for each turn a digest of all turns up to it and the code points of
its text, STEP bytes in all.  A path cut after d turns is therefore a node's identity, texts never move once they
are hashed, and equal conversations are counted before any depth is peeled.  Most depths of a corpus hold few
rows: the deepest ones, as long as their paths have at most DEEP_TURNS turns together, are peeled by one task in
one go; every other depth is one aggregation over all its rows, summed in the tasks before the shuffle, so a node
that a third of all conversations share costs no more than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.session import cut_lineage

from .sqltext import crc32_sql

#: Bytes of a turn in a path: a digest, and the text's code points as a big-endian number.
DIGEST, STEP = 16, 20
#: Turns of all paths together that the task of the deepest conversations peels.
DEEP_TURNS = 500_000
#: Conversation ids whose text is joined in one row before the hash over all of them.
IDS_AT_ONCE = 10_000
#: Fixed values of the rebuilt conversations: they share the beginning of every hundredth one.
BASES, MOST_SHARED = 100, 6

NODE = ("depth int, key binary, parent_key binary, path binary, conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, role, mark, size`` of every turn: its number from 1, its text's SHA-256 and code points.

    Turns go by ``turn``, null first; turns of one number by role and the text's SHA-256.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "mark")
    return rows.select("conv_id", F.row_number().over(order).alias("i"), "role", "mark", "size")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, i, role, mark, size``: each conversation with the beginning of its hundred's first one.

    Of conversation c the first h turns come from conversation c - c % 100 and the rest are its own after its
    first h, with h = crc32(c) % 6.  A row of part -1 stands for every conversation, also one without turns.
    """
    turns = ordered_turns(conversations)
    shared = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    ids = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct().withColumn("h", shared)
    heads = (turns.where((F.col("conv_id") % BASES == 0) & (F.col("i") < MOST_SHARED))
             .withColumnRenamed("conv_id", "base"))
    first = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASES).join(heads, "base")
             .where("i <= h").select("conv_id", F.lit(0).alias("part"), "i", "role", "mark", "size"))
    own = (turns.where(F.col("i") > shared)
           .select("conv_id", F.lit(1).alias("part"), "i", "role", "mark", "size"))
    begin = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("i"), F.lit("").alias("role"),
                       F.lit("").alias("mark"), F.lit(0).alias("size"))
    return first.unionByName(own).unionByName(begin)


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of each conversation of ``conv_id, part, i, role, mark, size``."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, done = None, bytearray(), []
        for batch in batches:
            for conv_id, part, role, mark, size in zip(*(c.to_pylist() for c in batch.columns)):
                if now != conv_id:
                    if now is not None:
                        done.append((now, bytes(path)))
                    now, path = conv_id, bytearray()
                if part >= 0:
                    told = hashlib.blake2b(path[-STEP:], digest_size=DIGEST)
                    told.update(f"{mark}{role}".encode("utf-8", "surrogatepass"))
                    path += told.digest() + size.to_bytes(STEP - DIGEST, "big")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()),
                                                  pa.array([p for _, p in done], pa.binary())], ["conv_id", "path"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bytes(path)], pa.binary())],
                                             ["conv_id", "path"])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i")
            .select("conv_id", "part", "role", "mark", "size").mapInArrow(follow, "conv_id long, path binary"))


def _key(path: Column, depth: Column) -> Column:
    """Identity of the node at a depth of a path; the root's is empty."""
    return F.when(depth > 0, F.substring(path, (depth - 1) * STEP + 1, F.lit(DIGEST))).otherwise(F.lit(b""))


def _size(path: Column, depth: int) -> Column:
    """Code points of the text of a path's turn at a depth."""
    if depth == 0:
        return F.lit(0).cast("long")
    return F.conv(F.hex(F.substring(path, depth * STEP - STEP + DIGEST + 1, STEP - DIGEST)), 16, 10).cast("long")


def _peel_deepest(ended: DataFrame, least: int) -> DataFrame:
    """Nodes of depth ``least`` and more from ``path, n_convs, conv_id``, by one task; paths of the last ones."""

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            for path, n, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.setdefault(len(path) // STEP, []).append((path, n, conv_id, 0, 0, 0))
        alive: list = []
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()] + [pa.int64()] * 5
        names = [c.split()[0] for c in NODE.split(", ")]
        for depth in range(max(waiting, default=least - 1), least - 1, -1):
            nodes: dict[bytes, list] = {}
            low = (depth - 1) * STEP
            for path, n, conv_id, children, leaves, saved in alive + waiting.pop(depth, []):
                node = nodes.setdefault(path[low:low + DIGEST], [path, 0, conv_id, 0, 0, 0])
                node[1] += n
                node[2] = min(node[2], conv_id)
                node[3] += children
                node[4] += leaves
                node[5] += saved
            for node in nodes.values():
                size = int.from_bytes(node[0][low + DIGEST:low + STEP], "big")
                node[4], node[5] = node[4] or 1, node[5] + (node[1] - 1) * size
            rows = [(depth, key, path[low - STEP:low - STEP + DIGEST] if depth > 1 else b"",
                     path[:depth * STEP] if depth == least else None, conv_id, n, children, leaves, saved)
                    for key, (path, n, conv_id, children, leaves, saved) in nodes.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            alive = [(path, n, conv_id, 1, leaves, saved) for path, n, conv_id, _, leaves, saved in nodes.values()]

    return ended.select("path", "n_convs", "conv_id").repartition(1).mapInArrow(peel, NODE)


def _peel_depth(ended: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
    """Nodes of one depth from the conversations that end there and the nodes of the depth below."""
    rows = ended.select("path", "n_convs", "conv_id", *(F.lit(0).cast("long").alias(c)
                                                        for c in ("n_children", "n_leaves", "saved_tokens")))
    if below is not None:
        rows = rows.unionByName(below.select(
            F.substring("path", 1, depth * STEP).alias("path"), "n_convs", "conv_id",
            F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
    nodes = rows.groupBy("path").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    path, at = F.col("path"), F.lit(depth)
    return nodes.select(
        at.alias("depth"), _key(path, at).alias("key"),
        (_key(path, at - 1) if depth > 0 else F.lit(None).cast("binary")).alias("parent_key"), "path", "conv_id",
        "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * _size(path, depth)).alias("saved_tokens"))


def peel(ended: DataFrame) -> DataFrame:
    """All nodes of the trie of ``path, n_convs, conv_id``, one row per distinct path."""
    depth = (F.length("path") / STEP).cast("int")
    levels = ended.groupBy(depth.alias("depth")).agg(F.count("*").alias("n")).orderBy(F.desc("depth")).collect()
    if not levels:
        return ended.sparkSession.createDataFrame([], NODE)
    turns, least, found, below = 0, 1, [], None
    for row in levels:
        turns += row.n * row.depth
        if turns > DEEP_TURNS:
            least = row.depth + 1
            break
    if least <= levels[0].depth:
        found.append(cut_lineage(_peel_deepest(ended.where(F.length("path") >= least * STEP), least), "trie"))
        below = found[-1].where(F.col("depth") == least)
    for d in range(least - 1, -1, -1):
        below = cut_lineage(_peel_depth(ended.where(F.length("path") == d * STEP), below, d), "trie")
        found.append(below)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes.drop("path")


def ends(conversations: DataFrame) -> DataFrame:
    """``key, ends_sha256``: hash over the ids of the conversations that end in a node, in rising order.

    Ids are joined to text in runs of IDS_AT_ONCE numbers by many tasks; only the hash over a node's runs, which
    cannot be shared out, is one task's work, and it holds one run at a time.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(run.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"key": k, "ends_sha256": s} for k, s in done], schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"key": now, "ends_sha256": state.hexdigest()}], schema)

    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key = _key(F.col("path"), (F.length("path") / STEP).cast("int"))
    runs = (conversations.select(key.alias("key"), "conv_id", F.floor(F.col("conv_id") / IDS_AT_ONCE).alias("run"))
            .groupBy("key", "run").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
            .select("key", "run", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("text")))
    return (runs.repartition("key").sortWithinPartitions("key", "run").select("key", "text")
            .mapInArrow(told, "key binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv_id, part, i, role, mark, size``, see :func:`rebuilt_turns`.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``; the root has
    depth 0 and is there as soon as there is a conversation.
    """
    every = cut_lineage(paths(turns), "paths")
    ended = cut_lineage(every.groupBy("path").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")),
                        "ended")
    nodes = cut_lineage(peel(ended), "trie")
    parents = (nodes.where("n_children > 0")
               .select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    return (nodes.join(parents, "parent_key", "left").join(ends(every), "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def trie_table(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations of ``conv_id, turn, role, text``.

    Null role and text are empty; turns without a ``conv_id`` belong to no conversation and are left out; repeated
    rows are turns of their own, and turns of equal number go by role and the text's SHA-256.  Texts of any length
    count by their hash; other columns, whatever their names, are not read; an empty table has no nodes.
    """
    return prefix_trie(rebuilt_turns(conversations))


TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {BASES} AS base, {crc32_sql('conv_id::VARCHAR')} % {MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
sequences AS (
  SELECT c.conv_id, coalesce(s, []) AS s FROM convs c LEFT JOIN (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, i) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)),
prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END AS size
  FROM prefixes GROUP BY d, p),
families AS (
  SELECT n.d, n.p, count(c.d) AS n_children FROM nodes n LEFT JOIN nodes c ON c.d = n.d + 1 AND c.p[1:n.d] = n.p
  GROUP BY n.d, n.p),
sums AS (
  SELECT a.d, a.p, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.p[1:a.d] = a.p JOIN families f ON f.d = b.d AND f.p = b.p
  GROUP BY a.d, a.p)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN families f ON f.d = n.d AND f.p = n.p JOIN sums s ON s.d = n.d AND s.p = n.p
  LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
