"""SimHash near-duplicates, linked exactly through a covering code.

The anchors are the words of the perfect [63, 57] Hamming code, over the lower 63 bits of a
fingerprint: every 63-bit string lies within one bit (the covering radius) of exactly one
anchor. Two fingerprints at most two bits apart have a string between them within one bit of
both, so the anchor of that string is within radius plus half the threshold, two bits, of
both. Replicating each distinct fingerprint to its anchors within two bits (32 at most)
hence loses no link, and does with 32 copies what radius plus the whole threshold on one
side would need 652 for. At most 4,034 different fingerprints lie so near one anchor, which
bounds what a task compares at once.

Defined cases: null and empty texts have fingerprint zero and link like others; repeated
rows share a class; a null key gets the component of its fingerprint; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE = 3
RADIUS = 2
_LOW = np.uint64(2**63 - 1)
_PARITY = np.array([sum(1 << (p - 1) for p in range(1, 64) if p >> j & 1) for j in range(6)], np.uint64)


def _flips() -> np.ndarray:
    """By syndrome: what turns a string into each code word within two bits (0 repeated)."""
    out = np.zeros((64, 32), np.uint64)
    for s in range(1, 64):
        pairs = [(p, p ^ s) for p in range(1, 64) if p < p ^ s]
        masks = [1 << (s - 1)] + [1 << (p - 1) | 1 << (q - 1) for p, q in pairs]
        out[s, : len(masks)] = masks
    return out


FLIPS = _flips()


def syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j in range(6):
        out |= (np.bitwise_count(x & _PARITY[j]).astype(np.int64) & 1) << j
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """The one anchor within a bit."""
    return x & _LOW ^ FLIPS[syndrome(x), 0]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, unsigned."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(shingle, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            fps = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, fp long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``radius`` (1 or 2) bits apart, once each."""
    if radius not in (1, 2):
        raise ValueError(f"anchors are made for a radius of 1 or 2, not {radius}")

    def replicate(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            if not len(fp):
                continue
            s = syndrome(fp)
            copies = np.where(s == 0, 1, 32)
            flip = FLIPS[s][np.arange(32) < copies[:, None]]
            again = np.repeat(fp, copies)
            yield pa.RecordBatch.from_arrays(
                [pa.array((again & _LOW ^ flip).view(np.int64)), pa.array(again.view(np.int64))], names=["anchor", "fp"]
            )

    def compare(batches):
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _and_last(batches):
            if batch is None:
                a, f, held_a, held_f = held_a, held_f, held_a[:0], held_f[:0]
            else:
                a = np.concatenate([held_a, np.asarray(batch.column(0))])
                f = np.concatenate([held_f, np.asarray(batch.column(1)).view(np.uint64)])
                # The last anchor's run may go on in the next batch.
                whole = int(np.searchsorted(a, a[-1])) if len(a) else 0
                a, held_a, f, held_f = a[:whole], a[whole:], f[:whole], f[whole:]
            for x, y in _near(a, f, radius):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    replicated = classes.select("fp").mapInArrow(replicate, "anchor long, fp long")
    by_anchor = replicated.repartition("anchor").sortWithinPartitions("anchor")
    return by_anchor.mapInArrow(compare, "a long, b long")


def _and_last(batches):
    yield from batches
    yield None


def _near(anchor: np.ndarray, fp: np.ndarray, radius: int):
    """Linked pairs within runs of one anchor; each only at the anchor of the string between."""
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(anchor)))
    end = np.repeat(start + size, size)
    at = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(at):
        at = at[at + step < end[at]]
        x, y = fp[at], fp[at + step]
        close = np.bitwise_count(x ^ y) <= radius
        i, x, y = at[close], x[close], y[close]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = (low ^ high) & _LOW
        first = apart & (~apart + np.uint64(1))
        between = np.where(np.bitwise_count(apart) == 2, low ^ first, low & _LOW)
        mine = nearest(between).view(np.int64) == anchor[i]
        if mine.any():
            yield low[mine], high[mine]
        step += 1


def near_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links."""
    fps = stored(fingerprints(df, text, key, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    label = components(links(classes, radius)).select(F.col("node").alias("fp"), "label")
    labelled = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    return fps.join(labelled.join(lowest, "label").select("fp", "component"), "fp").select("key", "fp", "component")


def hex_of(fp):
    """Sixteen lower-case hex digits of a signed column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
