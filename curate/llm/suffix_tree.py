"""Removal of every copy of repeated word runs, from prefix-partitioned suffix trees.

Suffixes (of words) that can have a twin (see ``repeats``) are partitioned by prefix: first
by one word, and where a partition is over ``MEMBERS`` suffixes, by a prefix twice as long,
up to the whole window. Only then is anything sorted or held as a table, so a partition
bounds the memory: of one that is still too large at a whole window all members are equal,
and a single node. Each other partition's subtree is built on its own, from its suffixes in
order and the depths at which neighbours part: a stack turns these into the internal nodes,
each with its depth and its leaves. Internal nodes at least a window deep are the repeats
that count, and all windows at their leaves go.

Defined cases: a null or empty text has no words; texts under a window keep all; rows equal
in id and text are one document and get the same result; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import utf8, word_hashes, word_spans
from .repeats import Kind, ranges, with_spans

WINDOW = 35
MEMBERS = 50_000


def partitions(words: np.ndarray, places: np.ndarray, window: int = WINDOW, members: int = MEMBERS):
    """(prefix length, places) of suffixes with common prefixes, ``members`` at most unless equal for a window.

    ``words`` must be padded by a window. Small neighbours in prefix order share a group;
    its prefix length is what all its members have in common for sure.
    """
    pending = [(0, places)]
    while pending:
        known, group = pending.pop()
        if len(group) <= members or known == window:
            yield known, group
            continue
        length = min(window, max(1, 2 * known))
        columns = [words[group + i] for i in range(known, length)]
        order = np.lexsort(columns[::-1])
        group, columns = group[order], [c[order] for c in columns]
        parts = np.zeros(len(group) - 1, bool)
        for c in columns:
            parts |= c[1:] != c[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(parts) + 1, [len(group)]])
        begin = 0
        for i in range(1, len(bounds)):
            if i + 1 < len(bounds) and bounds[i + 1] - bounds[begin] <= members:
                continue
            part = group[bounds[begin] : bounds[i]]
            if i - begin == 1:
                pending.append((length, part))
            else:
                yield known, part
            begin = i


def leaves(words: np.ndarray, places: np.ndarray, known: int = 0, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the depth at which each parts from the next, a window at most."""
    columns = [words[places + i] for i in range(known, window)]
    order = np.lexsort(columns[::-1]) if columns else np.arange(len(places))
    depth = np.full(max(len(places) - 1, 0), known, np.int64)
    alike = np.ones(len(depth), bool)
    for c in columns:
        c = c[order]
        alike &= c[1:] == c[:-1]
        depth += alike
    return places[order], depth


def internal_nodes(depth: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the subtree's internal nodes, children before parents."""
    nodes: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # open nodes: depth and first leaf, deeper ones on top
    for leaf, d in enumerate(depth.tolist()):
        first = leaf
        while stack and stack[-1][0] > d:
            deeper, first = stack.pop()
            nodes.append((deeper, first, leaf))
        if not stack or stack[-1][0] < d:
            stack.append((d, first))
    while stack:
        deeper, first = stack.pop()
        nodes.append((deeper, first, len(depth)))
    return nodes


def repeated_windows(entries: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of all windows of a bucket: those that stand at least twice."""
    count = entries["n"].astype(np.int64)
    owner = np.repeat(np.arange(len(entries)), count)
    places = ranges(bounds[:-1], count)
    # Open segments known to stand twice as a whole are settled as such.
    mask = entries["twice"][owner] > 0
    padded = np.concatenate([words, np.zeros(WINDOW, np.uint64)])
    window_at = np.zeros(len(words) + 1, np.int64)
    window_at[places] = np.arange(len(places))
    for known, group in partitions(padded, places):
        ordered, depth = leaves(padded, group, known)
        for deep, first, last in internal_nodes(depth):
            if deep >= WINDOW:
                mask[window_at[ordered[first : last + 1]]] = True
    return mask


KIND = Kind(WINDOW, 8, by_words=True, first_stays=False)
_SCHEMA = "key long, n_words long, n_removed long, kept string"


def _words(column):
    data, bounds = utf8(column)
    starts, ends, first = word_spans(data, bounds)
    return word_hashes(data, starts, ends), first


def _finish(rows: pa.Table, removed: np.ndarray, bounds: np.ndarray) -> pa.Table:
    kept, gone = [], []
    for text, a, b in zip(rows["text"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        found = (text or "").encode().split()
        mask = removed[a:b]
        if mask.any():
            found = [w for w, out in zip(found, mask.tolist()) if not out]
        kept.append(b" ".join(found).decode())
        gone.append(int(mask.sum()))
    key = pa.array(np.asarray(rows["doc"].combine_chunks()))
    key = pa.compute.if_else(pa.compute.equal(key, -(2**63)), None, key)
    return pa.Table.from_arrays(
        [key, pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
        names=["key", "n_words", "n_removed", "kept"],
    )


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; kept words are joined by one space."""
    return with_spans(df, KIND, repeated_windows, _words, _finish, _SCHEMA, text, key)
