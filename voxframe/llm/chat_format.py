"""Conversations as training text with a loss mask, by a compiled template, and read back from it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.template import Template

START, END = "<|im_start|>", "<|im_end|>"

TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_' ~ 'start|>' }}{{ message.role | label }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | control }}{% endgeneration %}"
    "{% else %}{{ message.text | control }}{% endif %}"
    "<|im_end|>\n"
    "{% endfor %}"
)

#: A row of formatted text is closed at this length, between two texts of the template.
PART_CHARS = 1 << 20

PARTS = "conv_id long, part int, last boolean, text string, loss_start array<int>, loss_end array<int>"
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """No `<|` stays: a backslash goes between, one more where there are some already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_label(role: str) -> str:
    """A role on one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_label(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS = {"control": escape, "label": escape_label}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 4 * PART_CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def parts(pieces: Iterator[tuple[str, int]], limit: int = PART_CHARS) -> Iterator[tuple[str, list[int], list[int], bool]]:
    """(text, loss starts, loss ends, last) of pieces of text; a generation block is never cut."""
    texts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    length, open_block = 0, 0
    for text, block in pieces:
        if length >= limit and (not block or block != open_block):
            yield "".join(texts), starts, ends, False
            texts, starts, ends, length, open_block = [], [], [], 0, 0
        if block:
            if block == open_block:
                ends[-1] = length + len(text)
            else:
                starts.append(length)
                ends.append(length + len(text))
        open_block = block
        texts.append(text)
        length += len(text)
    yield "".join(texts), starts, ends, True


def _formatter(source: str, limit: int):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        template = Template(source, FILTERS)
        for conv_id, turns in groupby(_rows(batches), lambda r: r[0]):
            messages = ({"turn": turn, "role": role, "text": text} for _, turn, role, text in turns)
            for k, (text, starts, ends, last) in enumerate(parts(template.render(messages, conv_id=conv_id), limit)):
                yield conv_id, k, last, text, starts, ends

    return lambda batches: _batches(rows(batches), schema, lambda r: len(r[3]))


def chat_format(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations: conv_id, part, last, text, loss_start, loss_end.

    The texts of a conversation's parts, by part, make up its whole text; only one of more
    than `part_chars` has several. [loss_start[i], loss_end[i]) are the code points of the
    part that the template marks as generation; one block is one span, an empty one included.

    Turns ascend by turn (null first), ties by role and text; repeated rows are turns of their
    own. A null role or text is empty. Rows with a null conv_id are one conversation. Further
    columns are ignored. No rows give no rows.

    Rows are shuffled by conversation and sorted on disk; a template that loops over its
    messages once takes them one by one, so a task holds a turn and a part of text, however
    long a conversation is. Templates that need the whole list hold it.
    """
    Template(template, FILTERS)  # errors show here rather than in a task
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatter(template, part_chars), PARTS)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


class _Reader:
    """Turns and masked texts of one conversation, part by part."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rest = conv_id, ""
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        self.chars += len(text)
        for a, b in zip(starts, ends, strict=True):
            own = unescape(text[a:b])
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        text, at = self.rest + text, 0
        while m := _TURN.match(text, at):
            self.turns += 1
            self.all.update(f"{unescape_label(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        self.rest = text[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id} holds text outside of turns")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows() -> Iterator[tuple]:
        reader = None
        for conv_id, part, text, starts, ends in _rows(batches):
            if part == 0:
                if reader:
                    yield reader.row()
                reader = _Reader(conv_id)
            reader.add(text, starts, ends)
        if reader:
            yield reader.row()

    return _batches(rows(), schema, lambda r: 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Reads text of TEMPLATE. turns_sha256 is over role, newline, text, newline of each turn,
    the loss digest over all masked texts without their escapes. Only conversations of several
    parts are shuffled. Text outside of turns is an error.
    """
    columns = ["conv_id", "part", "text", "loss_start", "loss_end"]
    short = F.col("last") & (F.col("part") == 0)
    whole = formatted.where(short).select(columns).mapInArrow(_read, _READ)
    cut = formatted.where(~short).select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read, _READ)
    return whole.unionByName(cut)
