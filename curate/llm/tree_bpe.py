"""BPE ids and texts back, with long unsplit text encoded in halves that are joined as a tree.

A tokenizer's file says how a text is normalised, where it is split, and which pairs merge.
Texts of ordinary length are encoded whole, as the tokenizers library does it. A longer one
is normalised and split first; runs of whole words become units of a bounded length, and a
word longer than a unit (text without any split) is halved until its parts are no longer
than one. Units are dealt to all tasks and encoded side by side, whatever document they
come from. Words need no joining. Where a text's characters are plain enough that case and
splits need no look at their neighbours, each task keeps the ids of words it has met and looks
them up; the ids are the same. The parts of one word are joined pair by pair as a tree:
the tokens around the join are encoded again, in a window that doubles until its first token
is the left side's own and its last the right side's.

That is exact. Merges are taken by rank, the leftmost of equals first, so tokens are the
encoding of their text exactly if every two neighbours are the encoding of theirs: the first
merge across a border would be the first in the text of the two tokens beside it as well.
All neighbours left of the window stood so in the left part, those in it in the window's
encoding, those right of it in the right part.

Defined cases: a null text is empty and has no ids; strings of added tokens become those
tokens, as in the library; repeated rows and ids, and rows without an id, are encoded each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, slices

#: Code points above which a text is cut, and those of a unit.
LONG = 1 << 15
UNIT = 1 << 13
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 4
#: Rows decoded at a time.
DECODED = 256
#: Words a task remembers, and the longest of them.
REMEMBERED = 200_000
LONGEST = 64

_WORDS, _ADDED, _OPEN, _CLOSED = range(4)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters that compose with none of each other and whose case is their own: up to the first
#: combining mark, and common punctuation.
_OTHER = re.compile("[^\x00-\u02ff\u2010-\u2027]")
#: White space among these, and what the file's pattern calls letters and numbers.
_SPACE = "\t-\r \x85\xa0"


def _plain_of(category: str) -> str:
    """The plain characters of a category, and those that they become in lower case."""
    plain = map(chr, [*range(0x300), *range(0x2010, 0x2028)])
    found = {each for c in plain for each in c + c.lower()}
    return "".join(re.escape(c) for c in sorted(found) if unicodedata.category(c).startswith(category))


_PLAIN_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _plain_pattern(told: dict) -> str | None:
    """The pattern of words, if the file lower-cases, splits by one pattern and maps bytes, no more."""
    normal, split = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    if normal.get("normalizers") != _PLAIN_NORMAL or len(split.get("pretokenizers", ())) != 2:
        return None
    first, last = split["pretokenizers"]
    plain = first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed" and "Regex" in first["pattern"]
    if not plain or last["type"] != "ByteLevel" or last["add_prefix_space"] or last["use_regex"]:
        return None
    pattern = first["pattern"]["Regex"].replace(r"\s", _SPACE)
    for category in "LN":
        pattern = pattern.replace(rf"\p{{{category}}}", _plain_of(category))
    return None if r"\p" in pattern else pattern


class _Words(dict):
    """Ids of words as bytes, remembered."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.bytes = model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        # Letters and digits of ASCII stand for themselves among the signs for bytes.
        mapped = word if word.isascii() and word.isalnum() else self.bytes.pre_tokenize_str(word)[0][0]
        ids = array("i", [token.id for token in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """One tokenizer file: whole texts, and the parts that long texts are made of."""

    def __init__(self, path: str):
        # Spark runs the tasks side by side; threads within one would take others' cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path) as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain BPE can be joined from parts")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.strings = {number: token for token, number in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.closed = self.whole.model
        self.open = models.BPE(vocab=model["vocab"], merges=merges)
        # Splits and merges of text that is normalised and holds no added tokens.
        self.words = Tokenizer(self.closed)
        self.words.pre_tokenizer = self.whole.pre_tokenizer
        pattern = _plain_pattern(told)
        if pattern:
            self.split = re.compile(pattern).findall
        self.known = _Words(self.closed) if pattern else None
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that look at what stands beside them are not supported")
        self.marks = [{}, {}]
        for token in added:
            content = self.normal(token["content"]) if token["normalized"] else token["content"]
            self.marks[bool(token["normalized"])][content] = token["id"]

    def normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        ids = [self.looked_up(text) for text in texts]
        rest = [i for i, found in enumerate(ids) if found is None]
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, np.int32).tobytes()
        return ids

    def looked_up(self, text: str) -> bytes | None:
        """The ids of a text of plain characters, from those of its words; None for other texts."""
        if self.known is None or _OTHER.search(text) or any(mark in text for marks in self.marks for mark in marks):
            return None
        return b"".join(map(self.known.__getitem__, self.split(text.lower())))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def _between(self, text: str, marks: dict[str, int]) -> Iterator[tuple[str, int | None]]:
        """Stretches of a text and the added tokens between them."""
        if not marks:
            yield text, None
            return
        pattern = "|".join(map(re.escape, sorted(marks, key=len, reverse=True)))
        at = 0
        for m in re.finditer(pattern, text):
            yield text[at : m.start()], None
            yield m[0], marks[m[0]]
            at = m.end()
        yield text[at:], None

    def units(self, text: str, most: int = UNIT) -> Iterator[tuple[int, str, int]]:
        """(kind, text, id) in order: runs of words, added tokens, parts of one long word."""
        for raw, mark in self._between(text, self.marks[0]):
            if mark is not None:
                yield _ADDED, "", mark
                continue
            for stretch, inner in self._between(self.normal(raw), self.marks[1]):
                if inner is not None:
                    yield _ADDED, "", inner
                else:
                    yield from self._cut(stretch, most)

    def _cut(self, text: str, most: int) -> Iterator[tuple[int, str, int]]:
        split = self.whole.pre_tokenizer.pre_tokenize_str(text) if self.whole.pre_tokenizer else [(text, (0, len(text)))]
        begin = end = None
        for word, (a, b) in split:
            if begin is not None and (len(word) > most or b - begin > most):
                yield _WORDS, text[begin:end], 0
                begin = None
            if len(word) > most:
                parts = [word]
                while len(parts[0]) > most:
                    parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
                for part in parts[:-1]:
                    yield _OPEN, part, 0
                yield _CLOSED, parts[-1], 0
                continue
            begin, end = a if begin is None else begin, b
        if begin is not None:
            yield _WORDS, text[begin:end], 0

    def encode_unit(self, kind: int, text: str, mark: int) -> list[int]:
        if kind == _ADDED:
            return [mark]
        if kind == _WORDS:
            found = self.looked_up(text)
            return self.words.encode(text, add_special_tokens=False).ids if found is None else np.frombuffer(found, np.int32).tolist()
        return self.part(text, kind == _CLOSED)

    def part(self, word: str, closed: bool) -> list[int]:
        """Ids of part of a word, whose end is the word's if ``closed``."""
        return [token.id for token in (self.closed if closed else self.open).tokenize(word)] if word else []

    def text_of(self, ids: list[int], closed: bool) -> str:
        found = "".join([self.strings[i] for i in ids])
        return found[: len(found) - len(self.suffix)] if closed and ids else found

    def join(self, left: list[int], right: list[int], closed: bool) -> list[int]:
        """Ids of two neighbouring parts as one; ``closed`` if the right one ends its word."""
        take = WINDOW
        while True:
            a, b = left[-take:], right[:take]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            ids = self.part(self.text_of(a, False) + self.text_of(b, closed and all_right), closed and all_right)
            if (all_left or ids[0] == a[0]) and (all_right or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            take *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Ids of a whole word from those of its parts, joined as a tree."""
        while len(parts) > 1:
            parts = [
                self.join(parts[i], parts[i + 1], i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
            ]
        return parts[0]


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _lists(ids: list[bytes] | list[list[int]]) -> pa.Array:
    rows = [row if isinstance(row, bytes) else np.array(row, np.int32).tobytes() for row in ids]
    ends = np.cumsum([0, *(len(row) // 4 for row in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, long: int = LONG, unit: int = UNIT) -> DataFrame:
    """(key, ids): the ids of every text. ``path`` must be readable on all executors."""
    path = path or default_path()
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bpe(path).encode(batch.column(1).to_pylist()))], names=["key", "ids"])

    def cut(batches):
        for batch in slices(batches, 2):
            for number, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(number, name, seq, *u) for seq, u in enumerate(bpe(path).units(content, unit))]
                # A text of white space alone has no units; its row must not get lost.
                yield _batch(found or [(number, name, 0, _WORDS, "", 0)], _UNITS)

    def encode_units(batches):
        for batch in slices(batches, 4):
            *place, contents, marks = (c.to_pylist() for c in batch.columns)
            ids = [bpe(path).encode_unit(*u) for u in zip(place[3], contents, marks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(ids)], names=["number", "key", "seq", "kind", "ids"])

    def assemble(batches):
        held: tuple | None = None
        for batch in batches:
            for number, name, kind, ids in zip(*(batch.column(c).to_pylist() for c in ("number", "key", "kind", "ids"))):
                if held and held[0] != number:
                    yield _done(held)
                    held = None
                held = held or (number, name, [], [])
                if kind in (_OPEN, _CLOSED):
                    held[3].append(ids)
                if kind == _CLOSED:
                    held[2].extend(bpe(path).join_all(held[3]))
                    held[3].clear()
                elif kind != _OPEN:
                    held[2].extend(ids)
        if held:
            yield _done(held)

    def _done(held):
        return pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), _lists([held[2]])], names=["key", "ids"])

    short = rows.where(F.length("text") <= long).mapInArrow(whole, "key long, ids array<int>")
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "key", "text").where(F.length("text") > long)
    parts = shuffle_parts(df.sparkSession)
    units = numbered.mapInArrow(cut, "number long, key long, seq int, kind int, text string, id int").repartition(parts, "number", "seq")
    encoded = units.mapInArrow(encode_units, "number long, key long, seq int, kind int, ids array<int>")
    whole_again = encoded.repartition(parts, "number").sortWithinPartitions("number", "seq")
    return short.unionByName(whole_again.mapInArrow(assemble, "key long, ids array<int>"))


_UNITS = [("number", pa.int64()), ("key", pa.int64()), ("seq", pa.int32()), ("kind", pa.int32()), ("text", pa.string()), ("id", pa.int32())]


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` (key, ids) with the text of its ids as ``decoded``; added tokens are kept."""
    path = path or default_path()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch = whole.slice(at, DECODED)
                texts = bpe(path).decode([row or [] for row in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["key", "ids", "decoded"])

    return encoded.select("key", F.col(ids).alias("ids")).mapInArrow(run, "key long, ids array<int>, decoded string")
