"""What several operators share: words, keys, scratch tables, hashing of token arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared scratch folder and read it back.

    Cuts the lineage, gives the planner the table's true size, and survives executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- inside tasks ------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins and ends (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Arrays over bytes and words are several times a text's size; tasks work on so much text at once.
SLICE_BYTES = 1 << 21


def slices(batches, column: int = 0, most: int = SLICE_BYTES):
    """Batches cut by rows so that a text column holds about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = utf8(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the first word of each row (rows + 1 entries)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACES[data]
    step = np.diff(inside)
    # A word also ends where its row does.
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts = np.sort(np.concatenate([starts, cuts]))
    ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, bounds)


_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: One odd 64-bit value a byte, fixed so that all workers agree.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _M, np.uint64))
    letters = BYTE_VALUES[data[np.repeat(starts, lengths) + place]] * powers[place]
    return mix(np.add.reduceat(letters, firsts) + lengths.astype(np.uint64))


class RunHashes:
    """Hashes of runs of units (bytes or words) by doubling: level j covers 2**j units."""

    def __init__(self, units: np.ndarray, longest: int):
        self.levels = [units]
        width = 1
        while 2 * width <= longest and len(self.levels[-1]) > width:
            last = self.levels[-1]
            factor = np.uint64((int(_M) * (2 * width + 1)) % 2**64)
            self.levels.append(last[:-width] * factor + (last[width:] ^ (last[width:] >> np.uint64(31))))
            width *= 2

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` units from each of ``places``; all must fit."""
        out = np.full(len(places), np.uint64(length), np.uint64)
        done = 0
        for j in range(len(self.levels) - 1, -1, -1):
            if length - done >= 1 << j:
                out = mix(out * _M + self.levels[j][places + done])
                done += 1 << j
        return out
