"""Windows that repeat over a corpus: what suffix-array and suffix-tree removal share.

Most suffixes have no twin, and need no place in a suffix structure. A window's anchor is
the least-hashed gram inside it, so equal windows have equal anchors at equal places.
Neighbouring windows with one anchor form a segment.

1. ``sift``: each task cuts its texts into segments, keeps one of each equal pair it sees
   itself, and deals the rest out by the anchor's hash. A segment equal to an earlier one
   is settled; one whose anchor stands in no other segment has no twin at all; the others,
   one of each kind, are left open.
2. ``open_contexts``: the open segments' texts go to buckets, again by anchor. There the
   caller's suffix structure decides window by window.
3. ``with_spans``: what was found goes back to the texts, which are dealt out once, by
   document, for both visits.

Rows travel as small tables packed in binaries, a row a task and bucket, so no key has many
rows. Documents are ordered by (doc_id, hash of the text); rows equal in both are one
document. A null id sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, RunHashes, mix, shuffle_parts, slices, stored, utf8, word_hashes, word_spans

CHUNK = 1 << 18
GROUP_ROWS = 1_000
BUCKETS_A_PART = 16

SPAN = np.dtype([("doc", "<i8"), ("place", "<u8"), ("n", "<u4")])
ENTRY = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("place", "<u8"), ("n", "<u4"), ("twice", "u1"), ("off", "<u2")])


class Kind:
    """What a window is made of: ``window`` units, anchors of ``gram`` (a power of two) units."""

    def __init__(self, window: int, gram: int, by_words: bool, first_stays: bool):
        self.window, self.gram, self.by_words, self.first_stays = window, gram, by_words, first_stays

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = utf8(column)
        if not self.by_words:
            return data, bounds
        starts, ends, first = word_spans(data, bounds)
        return word_hashes(data, starts, ends), first


def _chunks(bounds: np.ndarray, overlap: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole rows of about CHUNK units; longer rows in overlapping parts."""
    begin = 0
    rows = len(bounds) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + CHUNK, "right")) - 1)
        lo, hi = int(bounds[begin]), int(bounds[end])
        if hi - lo <= 2 * CHUNK:
            yield lo, hi
        else:
            for at in range(lo, hi, CHUNK):
                yield at, min(at + CHUNK + overlap, hi)
        begin = end


def segments(units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Of every segment: first window, number of windows, anchor's hash, segment's hash, anchor's distance."""
    w = window - gram + 1
    level = gram.bit_length() - 1
    found = []
    for lo, hi in _chunks(bounds, window - 1):
        n = hi - lo
        if n < window:
            continue
        runs = RunHashes(BYTE_VALUES[units[lo:hi]] if units.dtype == np.uint8 else units[lo:hi], window)
        grams = mix(runs.levels[level])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: n - window + 1], least[w - width : w - width + n - window + 1])
        rows = np.arange(np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, hi, "left"))
        begins = np.maximum(bounds[rows], lo) - lo
        starts = ranges(begins, np.maximum(np.minimum(bounds[rows + 1], hi) - lo - begins - window + 1, 0))
        if not len(starts):
            continue
        anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
        first, count, anchor = starts[new], np.diff(np.append(new, len(starts))), anchor[new]
        whole = runs.at(first, window) * np.uint64(0x9E3779B97F4A7C15) + runs.at(first + count - 1, window)
        whole = mix(whole ^ ((anchor - first).astype(np.uint64) << np.uint64(20)) ^ (count.astype(np.uint64) << np.uint64(40)))
        found.append((first + lo, count, grams[anchor], whole, anchor - first))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    # Overlapping parts of a long row give some windows twice; equal places are one.
    return tuple(np.concatenate(c) for c in zip(*found))


def group_of(doc: np.ndarray, sign: np.ndarray, groups: int) -> np.ndarray:
    """The same as ``group_column``: XXH64 of id and sign as one number, modulo the number of groups."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, bits):
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    x = np.atleast_1d(doc).view(np.uint64) ^ (np.atleast_1d(sign).astype(np.uint64) << np.uint64(31))
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), groups)


def group_column(doc: Column, sign: Column, groups: int) -> Column:
    """Texts under one id, null for one, go to different groups."""
    return F.pmod(F.xxhash64(doc.bitwiseXOR(F.shiftleft(sign, 31))), F.lit(groups)).cast("int")


def _groups_of(rows: np.ndarray, groups: int) -> np.ndarray:
    return group_of(rows["doc"], rows["place"] >> np.uint64(32), groups)


def keyed(df: DataFrame, text: str, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``doc`` (id, null as least), ``sign`` (32 bits of the text's hash), ``text``.

    Carried columns follow under numbers, so that no name can clash.
    """
    return df.select(
        F.coalesce(F.col(key).cast("long"), F.expr("-9223372036854775807L - 1")).alias("doc"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 32).alias("sign"),
        F.col(text).alias("text"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)),
    )


def _packed(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, at in zip(np.split(rows, cuts), np.concatenate([[0], cuts]).tolist()):
        if len(part):
            yield int(bucket[at]), part.tobytes()


def _one_of_each(rows: np.ndarray, first_stays: bool):
    """Of sorted entries: the first of each (h, s), and the spans that are settled by the rest."""
    same_kind = (rows["h"][1:] == rows["h"][:-1]) & (rows["s"][1:] == rows["s"][:-1])
    same_place = same_kind & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["place"][1:] == rows["place"][:-1])
    rows = rows[np.concatenate([[True], ~same_place])]
    same_kind = same_kind[~same_place] if len(same_place) else same_kind
    first = np.concatenate([[True], ~same_kind])
    at = np.flatnonzero(first)
    many = np.maximum.reduceat(rows["twice"], at) if len(at) else np.zeros(0, "u1")
    many = np.maximum(many, np.diff(np.append(at, len(rows))) > 1)
    kept = rows[at].copy()
    kept["twice"] = many
    settled = rows[~first] if first_stays else rows[np.repeat(many > 0, np.diff(np.append(at, len(rows))))]
    return kept, settled


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["place"], rows["doc"], rows["s"], rows["h"]))]


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    for name in SPAN.names:
        out[name] = rows[name]
    return out


_MARKS = "settled boolean, to int, rows binary"


def _mark_batch(rows: list[tuple[bool, int, bytes]]) -> pa.RecordBatch:
    settled, to, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(settled, pa.bool_()), pa.array(to, pa.int32()), pa.array(data, pa.binary())], names=["settled", "to", "rows"]
    )


def sift(texts: DataFrame, kind: Kind, groups: int) -> DataFrame:
    """Settled spans and open segments (settled, to, rows), by the documents' groups; stored."""
    buckets = BUCKETS_A_PART * shuffle_parts(texts.sparkSession)

    def cut(batches):
        for batch in slices(batches, 2):
            units, bounds = kind.units(batch.column(2))
            first, count, h, s, off = segments(units, bounds, kind.window, kind.gram)
            if not len(first):
                continue
            row = np.searchsorted(bounds, first, "right") - 1
            rows = np.empty(len(first), ENTRY)
            rows["h"], rows["s"], rows["n"], rows["twice"], rows["off"] = h, s, count, 0, off
            rows["doc"] = np.asarray(batch.column(0))[row]
            sign = np.asarray(batch.column(1)).view(np.uint64)[row]
            rows["place"] = sign << np.uint64(32) | (first - bounds[row]).astype(np.uint64)
            kept, settled = _one_of_each(_sorted(rows), kind.first_stays)
            # Found here, settled spans travel beside the entries to a bucket of their group.
            out = [(False, b, data) for b, data in _packed(kept, (kept["h"] % np.uint64(buckets)).astype(np.int64))]
            spans = _spans(settled)
            out += [(True, b, data) for b, data in _packed(spans, _groups_of(spans, groups))]
            yield _mark_batch(out)

    def settle(batches):
        for is_span, to, blobs in _runs(batches):
            if is_span:
                yield _mark_batch([(True, to, b"".join(blobs))])
                continue
            rows = np.concatenate([np.frombuffer(b, ENTRY) for b in blobs])
            kept, settled = _one_of_each(_sorted(rows), kind.first_stays)
            alone = np.concatenate([[True], kept["h"][1:] != kept["h"][:-1]]) & np.concatenate([kept["h"][1:] != kept["h"][:-1], [True]])
            still_open = kept[~alone]
            spans = _spans(settled)
            out = [(True, b, data) for b, data in _packed(spans, _groups_of(spans, groups))]
            out += [(False, b, data) for b, data in _packed(still_open, _groups_of(still_open, groups))]
            if out:
                yield _mark_batch(out)

    dealt = texts.select("doc", "sign", "text").mapInArrow(cut, _MARKS).repartition("settled", "to")
    return stored(dealt.sortWithinPartitions("settled", "to").mapInArrow(settle, _MARKS), "marks")


def _runs(batches) -> Iterator[tuple[bool, int, list[bytes]]]:
    """Blobs of one (settled, to) at a time, from sorted batches."""
    now, held = None, []
    for batch in batches:
        for settled, to, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now != (settled, to) and held:
                yield *now, held
                held = []
            now = (settled, to)
            held.append(blob)
    if held:
        yield *now, held


def open_contexts(texts: DataFrame, marks: DataFrame, kind: Kind, decide: Callable, groups: int, content: Callable) -> DataFrame:
    """Spans (settled, to, rows) that ``decide`` finds among open segments.

    ``content(column)`` gives a text column's flat units and bounds, as ``decide`` wants
    them. ``decide(segments, units, bounds)`` gets one bucket: its entries and their texts
    (from an entry's first window to the end of its last), and returns a window mask.
    """
    buckets = BUCKETS_A_PART * shuffle_parts(texts.sparkSession)
    schema = "to int, entries binary, content binary"

    def fetch(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = {"to": [], "entries": [], "content": []}
        if found.num_rows and rows.num_rows:
            entries = np.concatenate([np.frombuffer(b, ENTRY) for b in found["rows"].to_pylist()])
            units, bounds = content(rows["text"])
            at = _row_places(rows, entries)
            begin = bounds[at] + (entries["place"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            size = entries["n"].astype(np.int64) + kind.window - 1
            to = (entries["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(part):
                    out["to"].append(int(to[part[0]]))
                    out["entries"].append(entries[part].tobytes())
                    out["content"].append(units[ranges(begin[part], size[part])].tobytes())
        return pa.table([pa.array(out["to"], pa.int32()), pa.array(out["entries"], pa.binary()), pa.array(out["content"], pa.binary())], names=list(out))

    dtype = np.uint64 if kind.by_words else np.uint8

    def settle(batches):
        def whole(held):
            entries = np.concatenate([np.frombuffer(e, ENTRY) for e, _ in held])
            units = np.concatenate([np.frombuffer(c, dtype) for _, c in held])
            size = entries["n"].astype(np.int64) + kind.window - 1
            bounds = np.concatenate([[0], np.cumsum(size)])
            mask = decide(entries, units, bounds)
            return _mark_batch(_flagged(entries, mask, groups)) if mask.any() else None

        now, held = None, []
        for batch in batches:
            for to, e, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != to and held:
                    if (done := whole(held)) is not None:
                        yield done
                    held = []
                now = to
                held.append((e, c))
        if held and (done := whole(held)) is not None:
            yield done

    found = marks.where("NOT settled").select(F.col("to").alias("group"), "rows")
    contexts = texts.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(fetch, schema)
    return contexts.repartition("to").sortWithinPartitions("to").mapInArrow(settle, _MARKS)


def _flagged(entries: np.ndarray, mask: np.ndarray, groups: int):
    """Runs of flagged windows as spans, by group."""
    count = entries["n"].astype(np.int64)
    first = np.cumsum(count) - count
    at = np.flatnonzero(mask)
    owner = np.repeat(np.arange(len(entries)), count)[at]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner) != 0)]))
    spans = np.empty(len(new), SPAN)
    spans["doc"] = entries["doc"][owner[new]]
    spans["place"] = entries["place"][owner[new]] + (at[new] - first[owner[new]]).astype(np.uint64)
    spans["n"] = np.diff(np.append(new, len(at)))
    return [(True, b, data) for b, data in _packed(spans, _groups_of(spans, groups))]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs given by begin and size, one after the other."""
    firsts = np.cumsum(size) - size
    return np.repeat(begin - firsts, size) + np.arange(int(size.sum()))


def _row_places(rows: pa.Table, spans: np.ndarray) -> np.ndarray:
    """The row of each span's document; of equal rows, the first."""
    doc = np.asarray(rows["doc"].combine_chunks())
    sign = np.asarray(rows["sign"].combine_chunks()).view(np.uint64)
    order = np.lexsort((sign, doc))
    pair = np.empty(len(doc), [("doc", "<i8"), ("sign", "<u8")])
    pair["doc"], pair["sign"] = doc[order], sign[order]
    want = np.empty(len(spans), pair.dtype)
    want["doc"], want["sign"] = spans["doc"], spans["place"] >> np.uint64(32)
    return order[np.searchsorted(pair, want)]


def removed_units(rows: pa.Table, found: pa.Table, bounds: np.ndarray, window: int) -> np.ndarray:
    """A mask over all units of a group's rows; equal rows are marked alike."""
    marks = np.zeros(int(bounds[-1]) + 1, np.int64)
    if found.num_rows and rows.num_rows:
        spans = np.concatenate([np.frombuffer(b, SPAN) for b in found["rows"].to_pylist()])
        at = _row_places(rows, spans)
        begin = bounds[at] + (spans["place"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + spans["n"].astype(np.int64) + window - 1, -1)
    mask = np.cumsum(marks[:-1]) > 0
    doc = np.asarray(rows["doc"].combine_chunks())
    sign = np.asarray(rows["sign"].combine_chunks())
    if len(doc) > 1:
        order = np.lexsort((sign, doc))
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            if doc[a] == doc[b] and sign[a] == sign[b]:
                mask[bounds[b] : bounds[b + 1]] = mask[bounds[a] : bounds[a + 1]]
    return mask


def with_spans(
    df: DataFrame, kind: Kind, decide: Callable, content: Callable, finish: Callable, schema: str, text: str, key: str,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Run all three steps; ``finish(rows, removed mask, bounds)`` makes a group's result.

    ``carry`` names columns of ``df`` that the result has too, as ``carried_0`` and so on.
    """
    groups = max(1, -(-df.count() // GROUP_ROWS))
    texts = keyed(df, text, key, carry)
    marks = sift(texts, kind, groups)
    dealt = texts.withColumn("group", group_column(F.col("doc"), F.col("sign"), groups))
    found = open_contexts(dealt, marks, kind, decide, groups, content)
    spans = marks.where("settled").union(found).select(F.col("to").alias("group"), "rows")

    def close(rows: pa.Table, got: pa.Table) -> pa.Table:
        units_bounds = _bounds_only(rows["text"], kind)
        out = finish(rows, removed_units(rows, got, units_bounds, kind.window), units_bounds)
        for name in carried:
            out = out.append_column(name, rows[name])
        return out

    carried = [f"carried_{i}" for i in range(len(carry))]
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in texts.select(*carried).schema)
    return dealt.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(close, schema)


def _bounds_only(column, kind: Kind) -> np.ndarray:
    data, bounds = utf8(column)
    return word_spans(data, bounds)[2] if kind.by_words else bounds
