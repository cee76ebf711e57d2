"""Conversations as training text, by a compiled template, with the stretches a model is to learn.

Control strings inside texts are escaped, so the output can be read back turn by turn and no text can forge a turn.
A template that goes through the messages once renders them as a stream: one message is held at a time, and a long
conversation leaves in pieces.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .template import BEGIN, END, TURN, Template

#: Turns with what is learnt: what an assistant says, without the marks around it.
TURNS = (
    '{% for m in messages %}{{ opening }}{{ m.role | guard(":") }}{{ between }}'
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}'
    "{{ closing }}{% endfor %}"
)
#: A piece of output ends with the turn that brings it to so many code points.
PIECE = 16 << 20


@dataclass(frozen=True)
class ChatFormat:
    """A template and its marks; a turn is ``opening role between text closing``.

    ``guard`` puts a backslash before each backslash and each ``mark`` or ``end`` inside a text, and before what else
    it is given; ``unguard`` takes these away. A template may hold other text between turns only where it has no
    ``opening``.
    """

    template: str = TURNS
    mark: str = "###"
    end: str = "</turn>"

    @property
    def opening(self) -> str:
        return f"{self.mark} "

    @property
    def closing(self) -> str:
        return f"{self.end}\n"

    def guard(self, value: object, *more: str) -> str:
        found = "|".join(map(re.escape, ("\\", self.mark, self.end, *more)))
        return re.sub(found, lambda m: "\\" + m.group(), "" if value is None else str(value))

    @functools.cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(r"\\(" + "|".join(map(re.escape, ("\\", self.mark, self.end, ":"))) + ")")

    def unguard(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    @functools.cached_property
    def _stop(self) -> re.Pattern:
        return re.compile(self._escaped.pattern + "|(?P<stop>" + "|".join(map(re.escape, (self.end, ": "))) + ")")

    def compiled(self) -> Template:
        return Template(self.template, {"guard": self.guard}, {"opening": self.opening, "between": ": ", "closing": self.closing})

    def turns(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text of every turn of an output, or of a piece of it."""
        at = piece.find(self.opening)
        while at >= 0:
            at += len(self.opening)
            middle = self._next(piece, at, ": ")
            end = self._next(piece, middle + 2, self.end)
            yield self.unguard(piece[at:middle]), self.unguard(piece[middle + 2 : end])
            at = piece.find(self.opening, end + len(self.end))

    def _next(self, piece: str, at: int, what: str) -> int:
        for m in self._stop.finditer(piece, at):
            if m.group("stop") == what:
                return m.start()
        raise ValueError(f"a turn has no {what!r}")


FORMATTED = "conv_id long, piece int, formatted string, starts_at long, learnt array<long>"


def _rows(batches: Iterator[pa.RecordBatch], text: str, *columns: str) -> Iterator[tuple]:
    for b in text_slices(batches, text):
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def rendered(template: Template, messages: Iterable[dict], most: int) -> Iterator[tuple[str, int, list[int]]]:
    """An output in pieces: the text, where it starts, and the starts and ends of what is learnt, counted from the
    start of the output."""
    out, spans, n, begun, depth = [], [], 0, 0, 0
    for p in template.pieces(messages=messages):
        if p is BEGIN:
            depth += 1
            if depth == 1:
                spans.append(n)
        elif p is END:
            depth -= 1
            if not depth:
                spans.append(n)
        elif p is not TURN:
            out.append(p)
            n += len(p)
        elif n - begun >= most and not depth:
            yield "".join(out), begun, spans
            out, spans, begun = [], [], n
    if out or not begun:
        yield "".join(out), begun, spans


def format_conversations(rows: DataFrame, chat: ChatFormat = ChatFormat(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``conv_id, piece, formatted, starts_at, learnt``: each conversation's output, in pieces from 0 (mostly one).

    ``learnt``: starts and ends of the stretches under generation marks, in turn, as code points from the start of
    the whole output; the piece itself starts at ``starts_at``. Messages have ``role`` and ``text``, null ones count
    as empty; they go by turn (null first), those of one turn by role and text, and repeated ones all stay. Rows of
    a null ``conv_id`` are one conversation. An empty table gives no rows; other columns are not read.

    One shuffle by conversation, sorted with spills. A task holds one message and one piece, however long the
    conversation, if the template goes through the messages once; else the list of a conversation's messages.
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, schema = chat.compiled(), pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("starts_at", pa.int64()), ("learnt", pa.list_(pa.int64()))])
        streams = template.streams("messages")
        held, size = [], 0
        for conv, own in groupby(_rows(batches, "text", "conv", "role", "text"), itemgetter(0)):
            messages = ({"role": r, "text": t} for _, r, t in own)
            for k, (text, begun, spans) in enumerate(rendered(template, messages if streams else list(messages), piece)):
                held.append({"conv_id": conv, "piece": k, "formatted": text, "starts_at": begun, "learnt": spans})
                size += len(text)
                if size > 4 << 20 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return own.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(formatted, FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """Pieces that were written and read again, as the readers below need them: a conversation's in one partition, in
    turn. What :func:`format_conversations` returns lies so already."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")


def read_turns(formatted: DataFrame, chat: ChatFormat = ChatFormat()) -> DataFrame:
    """``conv_id, pos, role, text`` of every turn, from the output alone; an output without turns gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in groupby(_rows(batches, "formatted", "conv_id", "formatted"), itemgetter(0)):
            pos = 0
            for _, text in own:
                turns = list(chat.turns(text or ""))
                roles, texts = zip(*turns) if turns else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(turns), pa.int64()), pa.array(range(pos, pos + len(turns)), pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "pos", "role", "text"])
                pos += len(turns)

    return formatted.select("conv_id", "formatted").mapInArrow(read, "conv_id long, pos long, role string, text string")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digest(formatted: DataFrame, chat: ChatFormat = ChatFormat()) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, read back
    from its output: the turns as ``role\\ntext\\n`` each, and what is learnt, both unescaped. Pieces are digested one
    by one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")])
        held = []
        for conv, own in groupby(_rows(batches, "formatted", "conv_id", "formatted", "starts_at", "learnt"), itemgetter(0)):
            turns, loss, n, learnt, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, begun, spans in own:
                size += len(text)
                for role, said in chat.turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(spans[::2], spans[1::2]):
                    said = chat.unguard(text[a - begun : b - begun])
                    loss.update(said.encode())
                    learnt += len(said)
            held.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), size))
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return formatted.select("conv_id", "formatted", "starts_at", "learnt").mapInArrow(read, DIGEST)
