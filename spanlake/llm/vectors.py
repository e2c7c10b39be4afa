"""Near-duplicate embeddings: inverted lists with product-quantised residuals, exact cosine rerank.

Vectors are scaled to length 1, so a cosine of at least ``least`` is a distance of at most r.  If two
such vectors have different home lists, one of them lies within r / 2 of the plane that separates
the two lists' centres; each vector therefore visits every list whose plane is that near, and every
linked pair meets in a list.  In many dimensions that is more than needed: what counts is the part of
the pair's difference along the plane's normal, which for differences in many directions is far less than r.
How much it is depends on the data, so it is measured on links inside some whole lists, and where there are few
of these, or an exact result is asked for, r itself is taken.  There, asymmetric distances from the visitor to the coded members
(centre plus residual codes) give a shortlist: a member's own coding error bounds how far its true
distance can be from the coded one, so no linked pair is lost.  The exact cosine decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanlake.session import cut_lineage

from .components import components

LEAST = 0.9
#: Centres and codes are fitted on at most so many vectors and numbers, the first by hash of id.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 4_000_000
#: Vectors per list aimed at, and the most lists.
PER_LIST, MOST_LISTS = 512, 4096
#: How far a link may reach across the plane between two lists is taken from links inside some whole lists: of
#: at most PROBE_ROWS vectors and PROBE_PAIRS links, the farthest one MARGIN times over.  With fewer than
#: LEAST_PAIRS links to judge by, or if asked to be exact, it is the length of the longest link there can be.
PROBE_ROWS, PROBE_PAIRS, LEAST_PAIRS, MARGIN = 16_384, 4_000, 300, 1.25
#: Dimensions of a subspace, codes per subspace, rounds of fitting.
SUB, CODES, ROUNDS, SEED = 4, 64, 8, 5
#: Members and visitors that meet in one task.
BLOCK = 1024
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, every component finite, length not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(vector.isNotNull() & good & (square > 0), F.lit(False))


@dataclass(frozen=True)
class VectorIndex:
    """List centres, and the codebook of each subspace of the residuals."""

    centres: np.ndarray
    books: np.ndarray  # subspaces x codes x SUB

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * SUB - x.shape[1])))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for low in range(0, len(x), 4096):
        out[low:low + 4096] = (half - x[low:low + 4096] @ centres.T).argmin(1)
    return out


def _means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means centres; an empty one stays where it was."""
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, rows: int) -> VectorIndex:
    """Index for ``rows`` vectors from a sample of unit vectors."""
    random = np.random.default_rng(SEED)
    lists = max(1, min(MOST_LISTS, rows // PER_LIST, len(sample) // 4))
    centres = _means(sample, lists, random)
    spaces = -(-sample.shape[1] // SUB)
    rest = np.pad(sample - centres[_nearest(sample, centres)], ((0, 0), (0, spaces * SUB - sample.shape[1])))
    books = [_means(rest[:, s * SUB:(s + 1) * SUB], CODES, random) for s in range(spaces)]
    books = [np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in books]
    return VectorIndex(centres, np.stack(books))


def encode(index: VectorIndex, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals, and each vector's distance to what its codes stand for."""
    rest = index.padded(x - index.centres[home])
    codes = np.stack([_nearest(rest[:, s * SUB:(s + 1) * SUB], b) for s, b in enumerate(index.books)], 1)
    coded = np.concatenate([b[codes[:, s]] for s, b in enumerate(index.books)], 1)
    return codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(1))


def visited(index: VectorIndex, x: np.ndarray, home: np.ndarray, radius: float) -> list[np.ndarray]:
    """Other lists whose separating plane is within radius / 2 of each vector."""
    square = (index.centres ** 2).sum(1)
    out = []
    for low in range(0, len(x), 1024):
        some, own = x[low:low + 1024], home[low:low + 1024]
        far = square - 2 * some @ index.centres.T
        gap = far - far[np.arange(len(some)), own][:, None]
        between = np.sqrt(np.maximum(square + square[own][:, None] - 2 * index.centres[own] @ index.centres.T, 0))
        near = gap <= radius * between + _SLACK
        near[np.arange(len(some)), own] = False
        out += [np.flatnonzero(n) for n in near]
    return out


def crossing(index: VectorIndex, x: np.ndarray, y: np.ndarray, home: int, radius: float) -> float:
    """The farthest that any of the links x-y inside one list reaches along the normal of a plane that could part
    them."""
    others = np.delete(index.centres, home, 0) - index.centres[home]
    if not len(others) or not len(x):
        return 0.0
    width = np.sqrt((others ** 2).sum(1))
    normals = others / np.maximum(width, 1e-300)[:, None]
    middle = width / 2
    most = 0.0
    for low in range(0, len(x), 512):
        one, two = ((v[low:low + 512] - index.centres[home]) @ normals.T for v in (x, y))
        reached = np.abs(one - two)
        reached[middle - np.maximum(one, two) > radius] = 0  # too far from the plane to matter
        most = max(most, float(reached.max()))
    return most


def _reach(placed: DataFrame, index: VectorIndex, sizes: dict[int, int], least: float, radius: float) -> float:
    """How far links reach across planes, from the links inside some lists; see PROBE_ROWS."""
    random, chosen, rows = np.random.default_rng(SEED), [], 0
    for number in random.permutation(sorted(sizes)).tolist():
        if rows + sizes[number] <= PROBE_ROWS:
            chosen.append(number)
            rows += sizes[number]
    if len(index.centres) < 2 or not chosen:
        return radius
    found: dict[int, list] = {}
    for row in placed.where(F.col("home").isin(chosen)).select("home", "vector").collect():  # at most PROBE_ROWS
        found.setdefault(row.home, []).append(row.vector)
    pairs, most = 0, 0.0
    for home, some in sorted(found.items()):
        x = np.frombuffer(b"".join(some), "<f8").reshape(len(some), -1)
        for low in range(0, len(x), 1024):
            i, j = np.nonzero(np.triu(x[low:low + 1024] @ x[low:].T >= least, 1))
            if len(i) > PROBE_PAIRS:
                picked = random.choice(len(i), PROBE_PAIRS, replace=False)
                i, j = i[picked], j[picked]
            most = max(most, crossing(index, x[low + i], x[low + j], home, radius))
            pairs += len(i)
        if pairs >= 4 * PROBE_PAIRS:
            break
    return min(radius, MARGIN * most) if pairs >= LEAST_PAIRS else radius


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def shortlist(index: VectorIndex, queries: np.ndarray, centre: int, codes: np.ndarray,
              limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs whose asymmetric squared distance is within the member's limit.

    One table per query and subspace.  The sum over some subspaces is a lower bound, so after a
    third of them only the pairs still within the limit go on.
    """
    rest = index.padded(queries - index.centres[centre])
    tables = []
    for s, book in enumerate(index.books):
        part = rest[:, s * SUB:(s + 1) * SUB]
        tables.append(((part ** 2).sum(1)[:, None] - 2 * part @ book.T + (book ** 2).sum(1)).astype(np.float32))
    some = -(-len(tables) // 3)
    sums = np.zeros((len(queries), len(codes)), np.float32)
    for s in range(some):
        sums += tables[s][:, codes[:, s]]
    bound = limit.astype(np.float32) + np.float32(1e-4)  # above what single precision can lose
    i, j = np.nonzero(sums <= bound)
    total = sums[i, j]
    for s in range(some, len(tables)):
        total += tables[s][i, codes[j, s]]
    near = total <= bound[j]
    return i[near], j[near]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is linked with in this block, over any path) of the links a-b."""
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    x, y = where[:len(a)], where[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


_ENTRY = "list int, block int, visits array<int>, member boolean, node long, copies long, home int, vector binary"


def near_vectors(vectors: DataFrame, least: float = LEAST, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors are linked where their cosine, in double precision, is at least ``least``.  ``n_links``
    counts the other rows linked directly, ``component_id`` is the least vec_id reachable, and
    ``kept`` marks it.  Equal vectors are one node and count as often as they occur; vectors of
    different length are never linked; null, empty and zero vectors and those with null or
    non-finite components link with nothing.  A null vec_id is no node: its row has no links and a
    null component.  Other columns are ignored.

    Every link found is one.  None can be missed with ``exact``; without it, vectors look into another list only
    as far across the plane between as links inside some lists of these data do, see PROBE_ROWS.

    Members and visitors of a list meet in blocks of BLOCK by BLOCK in separate tasks, so a list
    with a large part of all rows is spread; a task returns a count per vector and a spanning set of
    links, never all pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Adding 0.0 makes -0.0 and 0.0 the same vector.
    nodes = cut_lineage(good.select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector"))
                        .groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    sizes = [r.n for r in nodes.select(F.size("vector").alias("n")).distinct().collect()]  # lengths in use
    radius = math.sqrt(2 - 2 * least) + _SLACK
    links, edges = [], []
    for size in sorted(sizes):
        same = nodes.where(F.size("vector") == size)
        counts, found = _one_length(spark, same, size, least, radius, exact)
        links.append(counts)
        edges.append(found)
    empty_links = spark.createDataFrame([], "node long, n long")
    empty_edges = spark.createDataFrame([], "a long, b long")
    linked = empty_links
    for part in links:
        linked = linked.unionByName(part)
    joined = empty_edges
    for part in edges:
        joined = joined.unionByName(part)
    own = nodes.select("node", F.col("copies")).join(
        linked.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(
        components(joined), "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    keyed = (good.select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector"))
             .join(nodes.select("vector", "node"), "vector").select("vec_id", "node").join(own, "node")
             .select("vec_id", "n_links", "component_id"))
    rest = rows.where(~(F.col("vec_id").isNotNull() & usable(F.col("vector")))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.unionByName(rest).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _one_length(spark, nodes: DataFrame, size: int, least: float, radius: float,
                exact: bool) -> tuple[DataFrame, DataFrame]:
    """``node, n`` and ``a, b`` of the links among vectors of one length."""
    total = nodes.count()
    some = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // size))
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(some).select("vector").collect()  # bounded
    sample = np.array([r.vector for r in picked], float)
    sample /= np.sqrt((sample ** 2).sum(1, keepdims=True))
    index = fit(sample, total)
    # At most MOST_LISTS centres and the codebooks; as arrays, which workers read without this package.
    sent = spark.sparkContext.broadcast((index.centres, index.books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = VectorIndex(*sent.value)
        for batch in batches:
            x = batch.column(0).values.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(_nearest(x, index.centres).astype(np.int32)),
                 pa.array([r.tobytes() for r in x], pa.binary())], ["node", "copies", "home", "vector"])

    at_home = cut_lineage(nodes.select("vector", "node", "copies").mapInArrow(
        assign, "node long, copies long, home int, vector binary"), "vector-homes")
    held = {r.home: r.m for r in at_home.groupBy("home").agg(F.count("*").alias("m")).collect()}  # MOST_LISTS rows
    reach = radius if exact else _reach(at_home, index, held, least, radius)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = VectorIndex(*sent.value)
        for batch in batches:
            lists = visited(index, _matrix(batch.column(3)), batch.column(2).to_numpy(), reach)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([v.tolist() for v in lists], pa.list_(pa.int32())), batch.column(3)],
                ["node", "copies", "home", "visits", "vector"])

    placed = cut_lineage(at_home.mapInArrow(
        look, "node long, copies long, home int, visits array<int>, vector binary"), "placed-vectors")
    # Blocks per list: of its members, and of all that come to see them.  One row per list.
    guests = {r.list: r.g for r in placed.select(F.explode("visits").alias("list")).groupBy("list")
              .agg(F.count("*").alias("g")).collect()}
    blocks = {k: (-(-m // BLOCK), -(-(m + guests.get(k, 0)) // BLOCK)) for k, m in held.items()}
    shape = spark.sparkContext.broadcast(blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shape.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lot = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            lot = lot.astype(np.int64)
            out: list[tuple] = []
            for k, (home, visits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                m, g = blocks[home]
                out += [(home, int(lot[k] % m) * g + j, True, k) for j in range(g)]
                for to in [home, *visits]:
                    if to in blocks:
                        m, g = blocks[to]
                        out += [(to, i * g + int(lot[k] // 7 % g), False, k) for i in range(m)]
            for low in range(0, len(out), 20_000):
                lists, numbers, is_member, k = zip(*out[low:low + 20_000])
                at = pa.array(k)
                own = pa.array([x if m else None for x, m in zip(k, is_member)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array(numbers, pa.int32()), batch.column(3).take(own),
                     pa.array(is_member), batch.column(0).take(at), batch.column(1).take(at),
                     batch.column(2).take(at), batch.column(4).take(at)],
                    ["list", "block", "visits", "member", "node", "copies", "home", "vector"])

    def meet(table: pa.Table) -> pa.Table:
        index, centre = VectorIndex(*sent.value), table.column("list")[0].as_py()
        table = table.combine_chunks()
        is_member = table.column("member").to_numpy()
        ours, theirs = table.filter(pa.array(is_member)), table.filter(pa.array(~is_member))
        x, y = (_matrix(t.column("vector").combine_chunks()) for t in (theirs, ours))
        a, b = theirs.column("node").to_numpy(), ours.column("node").to_numpy()
        weight_a, weight_b = theirs.column("copies").to_numpy(), ours.column("copies").to_numpy()
        home = theirs.column("home").to_numpy()
        goes = [set(v) for v in ours.column("visits").to_pylist()]
        codes, error = encode(index, y, np.full(len(y), centre))
        link_a, link_b = [], []
        for low in range(0, len(x), 256):
            some = x[low:low + 256]
            i, j = shortlist(index, some, centre, codes, (radius + error) ** 2)
            for part in range(0, len(i), 100_000):
                p, q = i[part:part + 100_000], j[part:part + 100_000]
                p, q = (z[np.einsum("ij,ij->i", some[p], y[q]) >= least] for z in (p, q))
                u, v = p + low, q
                # A pair of one list is seen from both sides; one of two lists from either side that
                # visits the other, and counts in the lower list if both do.
                inside = home[u] == centre
                keep = inside & (a[u] < b[v])
                for k in np.flatnonzero(~inside).tolist():
                    keep[k] = int(home[u[k]]) not in goes[v[k]] or centre < home[u[k]]
                link_a.append(u[keep])
                link_b.append(v[keep])
        u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (link_a, link_b))
        to_a = np.bincount(u, weight_b[v], len(a)).astype(np.int64)
        to_b = np.bincount(v, weight_a[u], len(b)).astype(np.int64)
        node, root = _spanning(a[u], b[v])
        some_a, some_b = np.flatnonzero(to_a), np.flatnonzero(to_b)
        none = np.full(len(some_a) + len(some_b), None, object)
        nodes_ = np.r_[a[some_a], b[some_b], node]
        return pa.table({
            "node": pa.array(nodes_, pa.int64()),
            "n": pa.array(np.r_[to_a[some_a], to_b[some_b], np.zeros(len(node), np.int64)]),
            "root": pa.array([*none, *root.tolist()], pa.int64())})

    entries = placed.mapInArrow(spread, _ENTRY)
    met = cut_lineage(entries.groupBy("list", "block").applyInArrow(meet, "node long, n long, root long"), "vector-links")
    return (met.groupBy("node").agg(F.sum("n").alias("n")),
            met.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
