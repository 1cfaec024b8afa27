"""Chat formatting, assembled from ids.

Each turn's segments (role, text) are encoded on their own, and reserved ids above the
vocabulary are spliced in for the marks, so no content can produce a mark. Beside the ids
stands the text form, in which marks are strings and the same strings inside content are
escaped: a run of n backslashes before a control string, or at the end of a segment,
becomes 2n + 1, or 2n. Masks follow from running sums of segment lengths.

Rows come out one a turn, in order, with the turn's place in its conversation, so a
conversation of any length streams through its task; nothing holds it whole.

Defined cases: null role or text is empty; a null conversation id is a conversation; turns
of equal number are ordered by role, then text, and repeated rows all count; an empty table
gives no rows; other columns are not read. Roles other than the four known are spelled out
between two marks.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

KNOWN = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:", "tool": "### Tool:"}
OTHER, END_ROLE, END_TURN = "### Role:", "</role>", "</turn>"
MARKS = [*KNOWN.values(), OTHER, END_ROLE, END_TURN]
#: Reserved ids begin above the vocabulary.
FIRST_RESERVED = 50_257
IDS = {mark: FIRST_RESERVED + i for i, mark in enumerate(MARKS)}
LOSS_ROLE = "assistant"

_CONTROL = "|".join(map(re.escape, MARKS))
_TO_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"(\\+)({_CONTROL})")
_END = re.compile(r"\\+\Z")
_MARK = re.compile(rf"(\\*)({_CONTROL})")

TURNS = "conv_id long, place long, ids array<int>, first_id long, loss_from long, loss_to long, formatted string, first_char long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_ids long, loss_ids long"
)


def escape(content: str) -> str:
    content = _TO_ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], content)
    return _END.sub(lambda m: m[0] * 2, content)


def unescape(content: str) -> str:
    content = _END.sub(lambda m: m[0][: len(m[0]) // 2], content)
    return _ESCAPED.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], content)


def turn_segments(role: str, text: str) -> list[tuple[str, bool]]:
    """(content, is a mark) in order."""
    if role in KNOWN:
        head = [(KNOWN[role], True)]
    else:
        head = [(OTHER, True), (role, False), (END_ROLE, True)]
    return [*head, (text, False), (END_TURN, True)]


def read_turn(ids: list[int], ranks: str) -> tuple[str, str, list[str]]:
    """Role and text from a turn's ids, and the segments they were decoded from."""
    parts: list = []
    run: list[int] = []
    for i in ids:
        if i >= FIRST_RESERVED:
            parts += [bpe.decode(ranks, run), MARKS[i - FIRST_RESERVED]]
            run = []
        else:
            run.append(i)
    if parts[1] == OTHER:
        return unescape(parts[2]), unescape(parts[4]), parts
    return next(r for r, mark in KNOWN.items() if mark == parts[1]), unescape(parts[2]), parts


def split_formatted(text: str) -> list[str]:
    """Cut the text form at its marks alone: those after an even number of backslashes."""
    out, at = [], 0
    for m in _MARK.finditer(text):
        if len(m[1]) % 2 == 0:
            out += [text[at : m.start(2)], m[2]]
            at = m.end(2)
    return [*out, text[at:]]


def assemble(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ranks: str | None = None) -> DataFrame:
    """One row a turn: ids, the loss span in the conversation's ids, the text form.

    ``first_id`` and ``first_char`` are the running sums before the turn.
    """
    ranks = ranks or bpe.default_ranks()

    def build(batches):
        now, place, at, chars = object(), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, who, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv_id != now:
                    now, place, at, chars = conv_id, 0, 0, 0
                ids: list[int] = []
                shown: list[str] = []
                loss = (0, 0)
                for part, is_mark in turn_segments(who, content):
                    piece = part if is_mark else escape(part)
                    shown.append(piece)
                    new = [IDS[part]] if is_mark else bpe.encode(ranks, piece).tolist()
                    if who == LOSS_ROLE and not is_mark:
                        loss = (len(ids), len(ids) + len(new))
                    ids += new
                line = "".join(shown)
                out.append((conv_id, place, ids, at, at + loss[0], at + loss[1], line, chars))
                place, at, chars = place + 1, at + len(ids), chars + len(line)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                names = [c.strip().split(" ")[0] for c in TURNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    empty = F.lit("")
    rows = df.select(
        F.col(conv).cast("long").alias("conv"), F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"), F.col(turn).alias("turn"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(build, TURNS)


def read_back(turns: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of each conversation, from the ids and spans that ``assemble`` returned.

    The ids are decoded, masks applied, escapes undone, and the text form is cut at its
    marks and must give the same segments. Takes the rows in the order ``assemble`` leaves.
    """
    ranks = ranks or bpe.default_ranks()

    def digest(batches):
        now: object = None
        seen = False
        state: list = []

        def closed():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6])

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "ids", "first_id", "loss_from", "loss_to", "formatted"))
            for conv_id, ids, first, loss_from, loss_to, formatted in zip(*columns):
                if not seen or conv_id != now:
                    if seen:
                        out.append(closed())
                    now, seen = conv_id, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text, parts = read_turn(ids, ranks)
                if split_formatted(formatted) != [*parts, ""]:
                    raise ValueError("the text form and the ids of a turn differ")
                masked = unescape(bpe.decode(ranks, ids[loss_from - first : loss_to - first]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
                state[5] += len(ids)
                state[6] += loss_to - loss_from
            if out:
                yield _rows(out)
        if seen:
            yield _rows([closed()])

    def _rows(out):
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
        names = [c.split(" ")[0] for c in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return turns.mapInArrow(digest, DIGESTS)
