"""Exact substring removal from a blockwise suffix array with a difference cover.

Suffixes that can have a twin (see ``repeats``) are sorted one bucket at a time. Positions
whose residue lies in a difference cover (modulo 31, six residues, so that any two suffixes
meet in the cover within 30 bytes) get ranks first, by three rounds of doubling, for 124
bytes. Sorting compares 31 bytes; longer ties are resolved by the ranks at the first shift
that takes both suffixes into the cover. So a task holds a bucket's text, a fifth of it in
ranks, and never a long comparison. Each bucket is worked off in parts of ``PART`` bytes
cut between anchors.

Defined cases: a null or empty text has no bytes; texts under a window keep all; documents
are ordered by (id, hash of the text), a null id first; rows equal in both are one document
and get the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import cmp_to_key, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import utf8
from .repeats import Kind, ranges, with_spans

WINDOW = 100
V = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
PART = 1 << 21


def _shifts() -> np.ndarray:
    """[residue, residue] -> least shift that takes both into the cover."""
    inside = np.isin(np.arange(2 * V) % V, COVER)
    return np.array([[next(d for d in range(V) if inside[i + d] and inside[j + d]) for j in range(V)] for i in range(V)])


SHIFT = _shifts()


def _words_at(data: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The 31 bytes from each place as four big-endian numbers (the last of seven bytes)."""
    out = []
    for at, n in ((0, 8), (8, 8), (16, 8), (24, 7)):
        value = np.zeros(len(places), np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | data[places + at + k]
        out.append(value)
    return out


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (most significant first), and each element's rank, equal for equals."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_key = k[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(data: np.ndarray) -> np.ndarray:
    """Rank by 124 bytes of each position in the cover; ``data`` must be padded by 4 * V."""
    n = len(data) - 4 * V
    at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    place = np.zeros(len(data), np.int64)
    rank = _dense(*(w.astype(np.uint64) for w in _words_at(data, at)))[1] + 1
    for reach in (V, 2 * V):
        place[:] = 0
        place[at] = rank
        rank = _dense(rank, place[at + reach])[1] + 1
    place[:] = 0
    place[at] = rank
    return place


def sort_suffixes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of what stands there (by 124 bytes at least).

    ``data`` must be padded by 5 * V.
    """
    ranks = cover_ranks(data)
    order, prefix = _dense(*_words_at(data, places))
    residue = places % V
    # Suffixes of one residue need one shift only.
    alone = ranks[places + SHIFT[residue, residue]]
    order = np.lexsort((alone, residue, prefix))
    by_prefix, by_residue = prefix[order], residue[order]
    same = by_prefix[1:] == by_prefix[:-1]
    mixed = np.unique(by_prefix[1:][same & (by_residue[1:] != by_residue[:-1])])
    if len(mixed):
        begin, end = np.searchsorted(by_prefix, mixed), np.searchsorted(by_prefix, mixed, "right")

        def compare(i, j):
            d = SHIFT[residue[i], residue[j]]
            return int(ranks[places[i] + d]) - int(ranks[places[j] + d])

        for a, b in zip(begin.tolist(), end.tolist()):
            order[a:b] = sorted(order[a:b].tolist(), key=cmp_to_key(compare))
    return order


def repeated_windows(entries: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of all windows of a bucket: those that also stand earlier."""
    mask = np.zeros(int(entries["n"].sum()), bool)
    order = np.argsort(entries["h"], kind="stable")
    h = entries["h"][order]
    size = np.diff(bounds)[order]
    count = entries["n"].astype(np.int64)
    first_window = np.cumsum(count) - count
    # One suffix bucket at a time: whole anchors, about PART bytes.
    part = np.cumsum(size) // PART
    starts = np.concatenate([[True], h[1:] != h[:-1]])
    part = part[np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))]
    for rows in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        own = entries[rows]
        # Anchors stand at multiples of V, so equal windows share a residue, and with it a shift.
        length = np.diff(bounds)[rows]
        slot = -(-(length + V - 1) // V) * V
        begin = np.cumsum(slot) - slot + -own["off"].astype(np.int64) % V
        flat = np.zeros(int(slot.sum()) + 5 * V, np.uint8)
        flat[ranges(begin, length)] = data[ranges(bounds[:-1][rows], length)]
        places = ranges(begin, own["n"].astype(np.int64))
        windows = np.repeat(first_window[rows] - (np.cumsum(count[rows]) - count[rows]), count[rows]) + np.arange(len(places))
        order_of = sort_suffixes(flat, places)
        sorted_places = places[order_of]
        equal = _equal_neighbours(flat, sorted_places)
        run = np.concatenate([[0], np.cumsum(~equal)])
        doc = np.repeat(own["doc"], count[rows])[order_of]
        inside = np.arange(len(places)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        place = (np.repeat(own["place"], count[rows]) + inside.astype(np.uint64))[order_of]
        by_time = np.lexsort((place, doc, run))
        earliest = np.concatenate([[True], run[by_time][1:] != run[by_time][:-1]])
        mask[windows[order_of[by_time[~earliest]]]] = True
    return mask


def _equal_neighbours(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether neighbouring suffixes share a whole window; compared byte by byte."""
    a, b = places[:-1], places[1:]
    equal = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in range(WINDOW):
        if not len(left):
            break
        differs = data[a[left] + k] != data[b[left] + k]
        equal[left[differs]] = False
        left = left[~differs]
    return equal


KIND = Kind(WINDOW, 32, by_words=False, first_stays=True)
_SCHEMA = "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept"


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """The mask without the bytes of characters that would lose only a part."""
    starts = np.flatnonzero(data & 0xC0 != 0x80)
    if not len(starts):
        return removed
    whole = np.minimum.reduceat(removed.view(np.uint8), starts)
    return np.repeat(whole, np.diff(np.append(starts, len(data)))).astype(bool)


def _finish(rows: pa.Table, removed: np.ndarray, bounds: np.ndarray, as_text: bool) -> pa.Table:
    data, _ = utf8(rows["text"])
    if as_text:
        removed = _whole_characters(data, removed)
    spans, kept = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        mask = removed[a:b]
        if mask.any():
            step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
            kept.append(data[a:b][~mask].tobytes())
        else:
            spans.append([])
            kept.append(data[a:b].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    key = pa.array(np.asarray(rows["doc"].combine_chunks()))
    key = pa.compute.if_else(pa.compute.equal(key, -(2**63)), None, key)
    kept = pa.array(kept, pa.binary())
    if as_text:
        kept = kept.cast(pa.string())
    return pa.Table.from_arrays([key, pa.array(np.diff(bounds)), pa.array(spans, kind), kept], names=["key", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: runs of bytes removed, and the bytes left.

    ``as_text`` shrinks the runs to whole characters and returns a string. Columns named in
    ``carry`` follow as ``carried_0`` and so on.
    """
    schema = _SCHEMA + (" string" if as_text else " binary")
    finish = partial(_finish, as_text=as_text)
    return with_spans(df, KIND, repeated_windows, utf8, finish, schema, text, key, carry)
