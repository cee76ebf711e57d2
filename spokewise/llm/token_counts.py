"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of texts are held as one ragged array of symbols. In every round each sequence
applies its own lowest-rank pair, at all its places at once; a sequence without a known pair is done,
and its surviving symbols are its tokens. A pair's rank is always above the ranks that made its parts
(checked when the vocabulary is read), so a round per sequence and rank equals one merge after another.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Pre-tokens whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000

NONE = np.int32(2**31 - 1)

#: Letters outside the blocks whose case and class have been the same in all versions of Unicode since 3.2.
_CHANGING = regex.compile(r"[^\x00-\u024F\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u2010-\u2027\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")


_NFC, _LOWER = tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()


@functools.lru_cache(maxsize=1)
def changed_classes() -> dict[int, str]:
    """Code points that the library and ``regex`` put in different classes, as a letter of the library's class.

    Only those are asked for whose class has changed since Unicode 3.2."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(every)
    mine = {c: k for k in "LN" for c in regex.findall(rf"\p{{{k}}}", text)}
    old = unicodedata.ucd_3_2_0.category
    doubtful = [c for c in every if not c.isspace() and mine.get(c, "") != (k if (k := old(c)[0]) in "LN" else "")]
    theirs = dict.fromkeys(doubtful, "")
    for k in "LN":
        rest = tokenizers.pre_tokenizers.Split(tokenizers.Regex(rf"\p{{{k}}}"), "removed").pre_tokenize_str(" ".join(doubtful))
        theirs.update(dict.fromkeys(set(doubtful).difference(*(piece for piece, _ in rest)), k))
    return {ord(c): {"L": "a", "N": "1", "": "!"}[k] for c, k in theirs.items() if k != mine.get(c, "")}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        made_at = np.full(int(max(vocab.values())) + 1, -1, dtype=np.int64)
        made_at[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) != len(pairs) or (np.maximum(made_at[left], made_at[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        keys = left << 20 | right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def lengths(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each of these pre-tokens."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        seq = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(sym), NONE, dtype=np.int64)
        rank[:-1] = np.where(seq[:-1] == seq[1:], self.ranks(sym[:-1], sym[1:]), NONE)
        out = size.copy()
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            counts = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(rank, starts)
            out[seq[starts]] = counts
            keep = np.repeat(lowest < NONE, counts)
            if not keep.all():
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                counts, lowest = counts[lowest < NONE], lowest[lowest < NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, counts)
            follows = hit & np.r_[False, hit[:-1]]
            if follows.any():  # a run of one symbol: pairs are taken from its left end
                first = np.maximum.accumulate(np.where(hit & ~follows, np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - first) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            new = np.cumsum(stay) - 1
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            at = new[at]
            at = np.union1d(at, at[at > 0] - 1)
            nxt = np.minimum(at + 1, len(sym) - 1)
            same = (nxt > at) & (seq[at] == seq[nxt])
            rank[at] = np.where(same, self.ranks(sym[at], sym[nxt]), NONE)
        return out

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand in it."""
        parts = self.added.split(text) if self.added else [text]
        found: list[str] = []
        for part in parts:
            if not part:
                continue
            if _CHANGING.search(part):  # case and class as the installed library has them
                part = _LOWER.normalize_str(_NFC.normalize_str(part))
                found += [part[m.start() : m.end()] for m in self.words.finditer(part.translate(changed_classes()))]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # letter by letter where a sigma would get its form at a word's end
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
            found += self.words.findall(part)
        return found, len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pre_tokens(x) if x else ([], 0) for x in texts]
        new: set[str] = set()
        for words, _ in split:
            new.update(words)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [w for w in new if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.lengths(fresh).tolist()))
        known = self.known.__getitem__
        return [sum(map(known, words)) + extra for words, extra in split]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row for each row of ``docs`` (repeated ones too); a null text counts as empty, with 0 tokens; an
    empty table gives no rows; other columns are not read. No shuffle: each input split is counted where
    it is read, and a worker holds one slice of texts and the remembered pre-tokens.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in text_slices(batches, "text", 2 << 20):
            n = bpe.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text: Column = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(counted, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
