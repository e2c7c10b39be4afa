"""Quality scores of documents, learned from pairs of a better and a worse one (Bradley-Terry)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanlake.session import cut_lineage

from .bytetext import chunks, fold_case, span_hashes, word_spans
from .language import held_out

STEPS, RIDGE = 25, 1e-3
#: Cells that all scores are counted in, and those that stand for their scores in the pairs.
CELLS, PAIR_CELLS = 4096, 512
#: Partitions of labelled rows; each sends its sums (0.3 MB at most) to the driver.
MOST_PARTS = 200
#: A score from this on predicts label 1.
CUT = 0.7

FEATURES = (
    "log_words", "word_length", "letters", "capitals", "digits", "sentence_marks", "symbols",
    "repeated_next", "distinct_words", "commonest_word", "marked_words", "capital_words",
    "long_words", "log_line_words", "repeated_lines",
)


def _per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.float64)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    n = len(at) - 1
    lower, upper = (data >= 97) & (data <= 122) | (data >= 128), (data >= 65) & (data <= 90)
    digit, gap = (data >= 48) & (data <= 57), (data == 32) | (data >= 9) & (data <= 13)
    mark = np.isin(data, np.frombuffer(b".,;:?'\"-()", np.uint8))
    symbol = ~(lower | upper | digit | gap | mark)

    def share(of: np.ndarray, base: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(of)]
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(base, 1)

    size = np.diff(at).astype(np.float64)
    letters = share(lower | upper, np.ones(n))
    starts, ends, rows = word_spans(data, at)
    words = _per_row(rows, n)
    many = np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(words)
    out[:, 2], out[:, 3] = share(lower | upper, size), share(upper, letters)
    out[:, 4], out[:, 5], out[:, 6] = share(digit, size), share(mark, size), share(symbol, size)
    if len(starts):
        hashes = span_hashes(fold_case(data), starts, ends)
        length = (ends - starts).astype(np.float64)
        symbols_to = np.r_[0, np.cumsum(symbol)]
        capitals_to, letters_to = np.r_[0, np.cumsum(upper)], np.r_[0, np.cumsum(lower | upper)]
        capitals, own = capitals_to[ends] - capitals_to[starts], letters_to[ends] - letters_to[starts]
        again = np.r_[False, (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])]
        order = np.lexsort((hashes, rows))
        fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])]
        runs = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
        most = np.zeros(n)
        np.maximum.at(most, rows[order][fresh], runs)
        out[:, 1] = _per_row(rows, n, length) / many
        out[:, 7] = _per_row(rows, n, again.astype(float)) / many
        # Distinct words against what a longer text can be expected to have.
        out[:, 8] = _per_row(rows[order][fresh], n) / many ** 0.9
        out[:, 9] = most / many
        out[:, 10] = _per_row(rows, n, (symbols_to[ends] > symbols_to[starts]).astype(float)) / many
        out[:, 11] = _per_row(rows, n, ((own > 1) & (capitals == own)).astype(float)) / many
        out[:, 12] = _per_row(rows, n, (length > 16).astype(float)) / many
    line_end = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[at[:-1][size > 0], line_end + 1])
    line_start = line_start[line_start < len(data)]
    if len(line_start):
        line_row = np.searchsorted(at, line_start, "right") - 1
        stop = np.minimum(np.r_[line_start[1:], len(data)], at[line_row + 1])
        lines = _per_row(line_row, n)
        out[:, 13] = np.log1p(words / np.maximum(lines, 1))
        text = span_hashes(data, line_start, stop)
        order = np.lexsort((text, line_row))
        same = np.r_[False, (text[order][1:] == text[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])]
        out[:, 14] = _per_row(line_row[order], n, same.astype(float)) / np.maximum(lines, 1)
    return out


@dataclass(frozen=True)
class QualityModel:
    """Feature scales, weights, and the Bradley-Terry score that separates the labels."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        raw = _basis((rows - self.centre) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -30, 30)))


def _basis(z: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, both bounded."""
    z = np.clip(z, -4, 4)
    return np.hstack([z, z * z / 4])


#: Sums over all labelled rows of a function of some rows' features and labels.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _counts(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(rows)], rows.sum(0)])


def _cells(scores: np.ndarray, low: float, width: float) -> np.ndarray:
    return np.clip(np.floor((scores - low) / width), 0, CELLS - 1).astype(int)


def _slope_and_bend(total: Total, basis, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss over all pairs of a label 1 and a label 0.

    A first pass counts scores in cells, and a cell's mean score stands for its rows.  What a row adds
    depends on its own score and on how often each score of the other label occurs, so sums over rows
    and by cell, of a second pass, stand for all pairs.
    """
    size, reach = len(weights), 4 * np.abs(weights).sum() + 1e-9
    width = 2 * reach / CELLS

    def counted(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        scores = basis(rows) @ weights
        cell = labels * CELLS + _cells(scores, -reach, width)
        return np.array([np.bincount(cell, w, 2 * CELLS) for w in (None, scores)], float)

    every = total(counted).reshape(2, 2, CELLS)
    used = np.flatnonzero(every[0].sum(0))
    first, step = used[0], (used[-1] - used[0]) // PAIR_CELLS + 1
    many, scored = np.zeros((2, 2, PAIR_CELLS))
    for k in (0, 1):
        np.add.at(many[k], (used - first) // step, every[0, k, used])
        np.add.at(scored[k], (used - first) // step, every[1, k, used])
    share = many / many.sum(1, keepdims=True)
    at = scored / np.maximum(many, 1)  # the mean score in a cell, by label
    lost = 1 / (1 + np.exp(np.clip(at[1][:, None] - at[0][None], -30, 30)))  # [cell of label 1, cell of label 0]
    curve = lost * (1 - lost)
    own = np.array([share[1] @ curve, curve @ share[0]])  # of a row, by label and cell
    grid = -reach + width * (first + step * np.arange(PAIR_CELLS + 1))
    apart = np.clip([grid[:, None] - at[1][None], at[0][None] - grid[:, None]], -30, 30)
    pull = np.array([-(1 / (1 + np.exp(-apart[0]))) @ share[1], 1 / (1 + np.exp(-apart[1])) @ share[0]])

    def summed(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        x = basis(rows)
        scores = x @ weights
        cell = (_cells(scores, -reach, width) - first) // step
        by_cell = np.column_stack([np.bincount(labels * PAIR_CELLS + cell, column, 2 * PAIR_CELLS) for column in x.T])
        squares = [(x[labels == k] * own[k][cell[labels == k], None]).T @ x[labels == k] for k in (0, 1)]
        pulls = [np.interp(scores[labels == k], grid, pull[k]) @ x[labels == k] for k in (0, 1)]
        return np.concatenate([by_cell.ravel(), *(q.ravel() for q in squares), *pulls])

    sums, n = total(summed), many.sum(1)
    by_cell, squares, pulls = np.split(sums, [2 * PAIR_CELLS * size, 2 * (PAIR_CELLS + size) * size])
    worse, better = by_cell.reshape(2, PAIR_CELLS, size) / n[:, None, None]
    squares = (squares.reshape(2, size, size) / n[:, None, None]).sum(0)
    across = better.T @ curve @ worse
    slope = (pulls.reshape(2, size) / n[:, None]).sum(0)
    return slope - RIDGE * weights, squares - across - across.T + RIDGE * np.eye(size)


def _quantile(total: Total, score, reach: float, n: int, share: float) -> float:
    """The score at a share of all ``n``, between the two nearest: their cells are cut finer three times."""
    rank = (n - 1) * share
    ranks = np.array([int(rank), min(int(rank) + 1, n - 1)])
    low, width = np.array([-reach, -reach]), 2 * reach / CELLS
    for _ in range(3):

        def counted(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
            found = np.floor((score(rows)[:, None] - low) / width)
            inside = np.clip(found, -1, CELLS).astype(int) + 1
            return np.concatenate([np.bincount(inside[:, k], minlength=CELLS + 2) for k in (0, 1)]).astype(float)

        until = np.cumsum(total(counted).reshape(2, CELLS + 2), axis=1)
        cell = np.array([np.searchsorted(until[k], ranks[k], "right") for k in (0, 1)]) - 1
        low, width = low + np.clip(cell, 0, CELLS - 1) * width, width / CELLS
    return float(low[0] + (rank - int(rank)) * (low[1] - low[0]))


def _learn(total: Total) -> QualityModel:
    """Weights by logistic loss on feature differences of all (label 1, label 0) pairs, by Newton steps.

    The threshold is the score quantile at the share of label 0.  Without both labels there is no
    pair: every score is then the same, above the cut only if all labels are 1.
    """
    width = len(FEATURES)
    both = total(lambda rows, labels: np.array([_counts(rows[labels == k]) for k in (0, 1)])).reshape(2, -1)
    bad, good = (int(k) for k in both[:, 0])
    if not good or not bad:
        shift = -1.0 if good else 1.0
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(2 * width), shift)
    n = good + bad
    centre = both[:, 1:].sum(0) / n
    spread = total(lambda rows, labels: ((rows - centre) ** 2).sum(0)) / n
    scale = np.maximum(np.sqrt(spread), 1e-6)

    def basis(rows: np.ndarray) -> np.ndarray:
        return _basis((rows - centre) / scale)

    weights = np.zeros(2 * width)
    for _ in range(STEPS):
        slope, bend = _slope_and_bend(total, basis, weights)
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-4 * max(1, np.abs(weights).max()):
            break
    reach = float(4 * np.abs(weights).sum() + 1e-9)
    threshold = _quantile(total, lambda rows: basis(rows) @ weights, reach, n, bad / n)
    return QualityModel(centre, scale, weights, threshold)


def fit_pairs(rows: np.ndarray, labels: np.ndarray) -> QualityModel:
    """The model of rows that are all here."""
    return _learn(lambda some: some(rows, labels))


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, feature...`` of each row; only id and whole text are read."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in chunks(batch.column(1)):
                found = features(data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *map(pa.array, found.T)], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(
        measure, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch whose first column is doc_id."""
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])


def fit(measured: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from all labelled rows that are not held out; ``measured`` is what ``with_features`` gives.

    Rows with a null id or label are no use and left out; a document with several labels counts
    with each.  Of rows that repeat an id, the one with the least features counts.  Tasks sum over
    their rows, and only sums reach the driver.
    """
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
             .where(~held_out(F.col("doc_id"), 2, 4)).select("doc_id", "quality"))
    single = (measured.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
              .groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("least")).select("doc_id", "least.*"))
    rows = single.join(known, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), *FEATURES)
    # Sums of reruns agree to the last bit, as rows come in the same order.
    learned = cut_lineage(rows.sortWithinPartitions("doc_id", *FEATURES, "quality"), "quality").coalesce(MOST_PARTS)

    def total(some: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = some(np.zeros((0, len(FEATURES))), np.zeros(0, int))
            for batch in batches:
                found = found + some(_rows(batch), batch.column("quality").to_numpy(zero_copy_only=False).astype(int))
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(found, float).tobytes()], pa.binary())], ["sums"])

        parts = learned.mapInArrow(add, "sums binary").collect()
        whole = some(np.zeros((0, len(FEATURES))), np.zeros(0, int)).astype(float)
        for part in parts:
            whole = whole + np.frombuffer(part.sums).reshape(whole.shape)
        return whole

    return _learn(total)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    A score uses the whole text alone, however long.  Null text scores as an empty one; repeated rows and equal
    texts get the same score; other columns, whatever their names, are not read; an empty table gives no rows.
    Features are measured once and stored; the model learns from them and scores them.
    """
    measured = cut_lineage(with_features(docs), "features")
    model = fit(measured, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch)))], ["doc_id", "score"])

    scored = measured.mapInArrow(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 2, 4).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
