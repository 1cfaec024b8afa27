"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Features are shares of kinds of characters, repeats and lengths,
of the line and of its neighbours; transitions tie neighbouring labels. The field is fitted
by gradient ascent on lines that carry their document's label, from a bounded number of
labelled rows (``most_rows``, picked by hash). Forward-backward marginals, weighted by line
length, give a document's mean; a logistic curve fitted on the same rows turns it into the
score. Only features travel to the driver, and only those of the sample; weights of fixed
size travel back, and every document is scored from its whole text.

Defined cases: a null or empty text is one empty line; rows with null keys or labels are not
learned from but are scored; repeated rows are scored each; with no labelled rows the score
is 0.5; an empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHashes, mix, slices, utf8, word_hashes, word_spans

MOST_ROWS = 4_000
EDGES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8], np.float32)
RUN = 4


def _kinds() -> np.ndarray:
    """Byte values by kind: upper, lower, digits, symbols, exclamations, bars, spaces, stops, others over 127."""
    out = np.zeros((9, 256), bool)
    out[0, 65:91] = out[1, 97:123] = out[2, 48:58] = True
    out[3, [ord(c) for c in "#*$%&<>"]] = True
    out[4, [ord(c) for c in "!?"]] = True
    out[5, ord("|")] = True
    out[6, [32, *range(9, 14)]] = True
    out[7, [ord(c) for c in ".,;:"]] = True
    out[8, 128:] = True
    return out


KINDS = _kinds()
VALUES = len(KINDS) + 5
WIDTH = VALUES * len(EDGES) + 2 * VALUES + 1


def line_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of every line in 0..1, bytes of every line, and each row's first line."""
    data, bounds = utf8(column)
    rows = len(bounds) - 1
    breaks = np.flatnonzero(data == 10)
    # A row of k breaks has k + 1 lines, empty ones too.
    row_of_break = np.searchsorted(bounds, breaks, "right") - 1
    first_line = np.concatenate([[0], np.cumsum(np.bincount(row_of_break, minlength=rows) + 1)]).astype(np.int64)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    size = ends - starts
    values = np.zeros((len(starts), VALUES), np.float32)
    letters = np.maximum(size, 1)
    for k, kind in enumerate(KINDS):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        values[:, k] = (total[ends] - total[starts]) / letters
    upper, lower = values[:, 0].copy(), values[:, 1]
    values[:, 0] = upper / np.maximum(upper + lower, 1e-6)
    k = len(KINDS)
    w_start, w_end, w_row = word_spans(data, bounds)
    hashes = word_hashes(data, w_start, w_end)
    at = np.searchsorted(w_start, np.stack([starts, ends]))
    count = at[1] - at[0]
    if len(hashes) >= RUN:
        row_of_word = np.repeat(np.arange(rows), np.diff(w_row))
        fits = np.flatnonzero(row_of_word[RUN - 1 :] == row_of_word[: len(row_of_word) - RUN + 1])
        keys = mix(RunHashes(hashes, RUN).at(fits, RUN) + row_of_word[fits].astype(np.uint64))
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = fits[times[back] > 1]
        marks = np.zeros(len(hashes) + RUN + 1, np.int64)
        np.add.at(marks, again, 1)
        np.add.at(marks, again + RUN, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(marks)[: len(hashes)] > 0)])
        values[:, k] = (covered[at[1]] - covered[at[0]]) / np.maximum(count, 1)
    word_bytes = np.concatenate([[0], np.cumsum(w_end - w_start)])
    values[:, k + 1] = (word_bytes[at[1]] - word_bytes[at[0]]) / np.maximum(count, 1) / 20
    values[:, k + 2] = np.log2(count + 1) / 12
    values[:, k + 3] = count == 0
    values[:, k + 4] = np.log2(np.diff(first_line)[np.repeat(np.arange(rows), np.diff(first_line))]) / 8
    return np.minimum(values, 1.0), size, first_line


def features(values: np.ndarray, first_line: np.ndarray) -> np.ndarray:
    """Thermometer codes of a line's values, its neighbours' values, and a constant."""
    n = len(values)
    coded = (values[:, :, None] > EDGES).reshape(n, -1).astype(np.float32)
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    before[first_line[:-1]] = 0
    after[first_line[1:] - 1] = 0
    return np.concatenate([coded, before, after, np.ones((n, 1), np.float32)], axis=1)


@dataclass
class Field:
    weights: np.ndarray
    #: Scores of staying bad, bad to good, good to bad, staying good.
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def forward_backward(state: np.ndarray, moves: np.ndarray, first_line: np.ndarray):
    """Marginals of a good line, and expected counts of moves, for many chains at once.

    Chains are handled longest first, step by step over all that are long enough.
    """
    lengths = np.diff(first_line)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first_line[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # chains longer than t
    emit = np.stack([np.zeros_like(state), state], axis=1).astype(np.float64)
    m = moves.reshape(2, 2)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)

    def lse(x):
        top = x.max(axis=1)
        return top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))

    for t in range(longest):
        i = begin[: alive[t]] + t
        alpha[i] = emit[i] if t == 0 else emit[i] + lse(alpha[i - 1][:, :, None] + m)
    for t in range(longest - 2, -1, -1):
        i = begin[: alive[t + 1]] + t
        beta[i] = lse((emit[i + 1] + beta[i + 1])[:, :, None] + m.T)
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(state), bool)
    inner[first_line[1:] - 1] = False
    i = np.flatnonzero(inner)
    pair = alpha[i][:, :, None] + m + (emit[i + 1] + beta[i + 1])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0).reshape(-1), i


def document_means(good: np.ndarray, size: np.ndarray, first_line: np.ndarray) -> np.ndarray:
    weight = np.maximum(size, 1).astype(np.float64)
    return np.add.reduceat(good * weight, first_line[:-1]) / np.add.reduceat(weight, first_line[:-1])


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(values: np.ndarray, size: np.ndarray, first_line: np.ndarray, label: np.ndarray, steps: int = 150) -> Field:
    """Penalised likelihood by Adam, then the logistic curve by Newton's method."""
    x = features(values, first_line)
    y = np.repeat(label, np.diff(first_line)).astype(np.float64)
    chains = len(label)
    theta = np.zeros(x.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, pairs, inner = forward_backward(x @ theta[:-4].astype(np.float32), theta[-4:], first_line)
        seen = np.bincount((2 * y[inner] + y[inner + 1]).astype(int), minlength=4)
        gradient = np.concatenate([x.T @ (y - good).astype(np.float32), seen - pairs]) / chains - 1e-3 * theta
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.999 * m2 + 0.001 * gradient**2
        theta += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    field = Field(theta[:-4].astype(np.float32), theta[-4:])
    good, _, _ = forward_backward(x @ field.weights, field.moves, first_line)
    z = _logit(document_means(good, size, first_line))
    a, b = 0.0, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a + b * z)))
        w = p * (1 - p) + 1e-6
        g = np.array([(label - p).sum(), ((label - p) * z).sum() - 0.1 * (b - 1)])
        h = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    field.shift, field.slope = float(a), float(max(b, 0.05))
    return field


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most_rows: int = MOST_ROWS) -> Field | None:
    """Fit on at most ``most_rows`` labelled rows; ``labels`` has (key, label 0/1)."""
    chosen = labels.where("key IS NOT NULL AND label IS NOT NULL").dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(most_rows)

    def run(batches):
        for batch in slices(batches, 1):
            values, size, first = line_values(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                    pa.array([size[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                ],
                names=["label", "line_values", "sizes"],
            )

    # At most ``most_rows`` keys, so they can go to every task.
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    sample = rows.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, line_values binary, sizes binary").collect()
    if not sample:
        return None
    values = np.concatenate([np.frombuffer(r["line_values"], np.float32).reshape(-1, VALUES) for r in sample])
    size = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in sample])
    first = np.concatenate([[0], np.cumsum([len(r["sizes"]) // 8 for r in sample])])
    return fit(values, size, first, np.array([r["label"] for r in sample], np.float64))


def score(df: DataFrame, field: Field | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, lines, bad_lines) of every row."""

    def run(batches):
        for batch in slices(batches, 1):
            n = batch.num_rows
            values, size, first = line_values(batch.column(1))
            if field is None:
                good, p = np.full(len(size), 0.5), np.full(n, 0.5)
            else:
                good, _, _ = forward_backward(features(values, first) @ field.weights, field.moves, first)
                p = 1 / (1 + np.exp(-(field.shift + field.slope * _logit(document_means(good, size, first)))))
            bad = np.add.reduceat((good < 0.5).astype(np.int64), first[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array(np.diff(first)), pa.array(bad)], names=["key", "score", "lines", "bad_lines"]
            )

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, score double, lines long, bad_lines long")
