"""SentencePiece encoding and decoding with a merge-type prefix table.

Every prefix of a text has one last piece in its encoding. The table holds that piece for each prefix: an
automaton gives the pieces that end there, and a piece is right if it is compatible with the last piece of
the prefix before it, that is if the two, merged alone, stay the two. Ids are then read backwards.

No piece has a word mark after another letter (checked), so a merge never crosses from a letter to a mark:
the table is made for each chunk (marks, then letters) alone, and a worker remembers chunks it has met.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
#: Chunks and pairs of pieces that a worker remembers; a memory is emptied when it is full.
REMEMBERED_CHUNKS = 500_000
REMEMBERED_PAIRS = 1_000_000

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTable:
    """The vocabulary of a BPE model, as tables for encoding and decoding."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.end = model.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.surface: list[str | int] = [""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface[i] = int(piece[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = model.get_score(i)
                self.surface[i] = piece
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark after a letter")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored pair first, the leftmost among equals. Only for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_whole(self, piece: int) -> bool:
        """Whether merging this piece's letters gives the piece."""
        got = self.whole.get(piece)
        if got is None:
            text = self.surface[piece]
            got = self.whole[piece] = self.merged(text) == [text]
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: merging the two alone leaves them as they are.

        Both are whole, so the two stay apart unless a merge across their border comes before the merges
        that make its sides part of larger pieces.
        """
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        a, b = self.surface[left], self.surface[right]
        got = self.pairs[left << 20 | right] = self.is_whole(right) and self.merged(a + b) == [a, b]
        return got

    def split(self, chunk: str) -> list[int]:
        """The pieces of a chunk, by its prefix table; -1 for a letter that is no piece and stands alone."""
        n = len(chunk)
        last = [-1] * (n + 1)
        pairs = self.pairs
        for at, (size, piece) in self.automaton.iter(chunk):  # by end, the longest first
            at += 1
            if last[at] >= 0:
                continue
            before = last[at - size]
            if before < 0:  # the chunk's start, or a letter that is no piece and takes part in no merge
                fits = self.is_whole(piece)
            else:
                fits = pairs.get(before << 20 | piece)
                if fits is None:
                    fits = self.fits(before, piece)
            if fits:
                last[at] = piece
        out, surface = [], self.surface
        while n:
            piece = last[n]
            out.append(piece)
            n -= len(surface[piece]) if piece >= 0 else 1
        out.reverse()
        return out

    def coded_chunk(self, chunk: str) -> tuple[str, str]:
        """Ids as decimals joined by spaces, and the text they decode to."""
        pieces = self.split(chunk)
        if -1 not in pieces:
            return " ".join(map(str, pieces)), self.text(pieces, first=False)
        out: list[int] = []
        at = 0
        for piece in pieces:
            if piece >= 0:
                out.append(piece)
                at += len(self.surface[piece])
            else:
                out += [self.byte[b] for b in chunk[at].encode()]
                at += 1
        return " ".join(map(str, out)), self.text(out, first=False)

    def text(self, ids: list[int], first: bool = True) -> str:
        """Decode: bytes in a row are read as UTF-8, marks become spaces, the first mark of all goes."""
        out, pending = [], bytearray()
        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                pending.append(s)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(s)
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        if first and ids and isinstance(s := self.surface[ids[0]], str) and s.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")

    def forget(self) -> None:
        """Gives back the memory that grows with the texts; a worker goes on to other work."""
        self.known.clear()
        self.pairs.clear()

    def remember(self, chunks: list[str]) -> None:
        if len(self.known) > REMEMBERED_CHUNKS:
            self.known.clear()
        known, coded = self.known, self.coded_chunk
        for c in chunks:
            if c not in known:
                known[c] = coded(c)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; a mark leads it, as the model's dummy prefix does.

        A text of words with single spaces between gives the words alone; each has a mark before it then.
        """
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        return text.split(" ")

    def coded(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Ids as decimals joined by spaces, and the decoded text, for each text."""
        split = []
        new: set[str] = set()
        for x in texts:
            words = self.chunks(x) if x else []
            plain = bool(words) and not words[0].startswith(MARK)  # single spaces only: words without their mark
            split.append((words, plain))
            new.update((MARK + w for w in set(words)) if plain else words)
        self.remember(list(new))
        known, out = self.known, []
        for words, plain in split:
            got = [known[MARK + w] for w in words] if plain else [known[w] for w in words]
            out.append((" ".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]))
        return out


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its encoding: ``doc_id, ids (array of int, the end id last), decoded``.

    A null or empty text gives the end id alone and an empty decoded text. Repeated rows are coded each;
    an empty table gives no rows; other columns are not read. Nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for b in text_slices(batches, "text", 1 << 20):
            got = table.coded(b.column("text").to_pylist())
            ids = [[*map(int, i.split()), table.end] for i, _ in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())], ["doc_id", "ids", "decoded"])
        table.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: ``doc_id, decoded``; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for b in batches:
            texts = [table.text(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(rows, "doc_id long, decoded string")


def code_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, as :func:`encode` codes it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for b in text_slices(batches, "text", 1 << 20):
            n, ids_sha, text_sha = [], [], []
            for ids, text in table.coded(b.column("text").to_pylist()):
                ids = f"{ids} {table.end}" if ids else str(table.end)
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
