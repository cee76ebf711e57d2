"""Removal of long word sequences that stand more than once, by recompression.

Words are named, and in each round neighbouring symbols whose coins show left and right are paired and named
anew. A name is a 64-bit function of what it stands for, so it is the same in every document and no round
needs a shuffle; equal neighbours show the same coin, so a run of one symbol stays a run. Whether two symbols
pair depends on the two alone, so in equal word sequences all symbols are equal but for 2**rounds - 1 words at
either end: each window has symbols of the last round inside that its own words decide. The longest of these
(among equals, the smallest by hash) is the window's key: shared keys reveal the passages that may repeat, and
the words of these passages verify it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix
from .repeats import cut_repeats, gathered
from .suffix_dedup import Runs, multikey_order, no_runs, tied_runs
from .windows import Sums, flat_bytes, ragged, slide, words

WINDOW, ROUNDS = 35, 3


def recompressed(name: np.ndarray, row: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the last round and the word that each starts at."""
    at = np.arange(len(name))
    for r in range(rounds):
        right = (mix(name + np.uint64(2 * r + 1)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (row[:-1] == row[1:]))
        name = name.copy()
        name[pair] = mix(name[pair] * np.uint64(3) + mix(name[pair + 1] + np.uint64(r)))
        stay = np.ones(len(name), dtype=bool)
        stay[pair + 1] = False
        name, at, row = name[stay], at[stay], row[stay]
    return name, at


class WordRuns:
    """Runs of word windows; the key is a symbol inside."""

    def __init__(self, window: int, rounds: int):
        self.window = window
        while rounds and window - 2 * (2**rounds - 1) < 2 ** (rounds + 1) - 1:
            rounds -= 1
        self.rounds, self.longest, self.margin = rounds, 2**rounds, 2**rounds - 1
        self.spread = window - 2 * self.margin - self.longest + 1  # places where an inner symbol may start

    def __call__(self, flat: np.ndarray, off: np.ndarray) -> Runs:
        start, end, before = words(flat, off)
        n = len(start) - self.window + 1
        if n <= 0:
            return no_runs()
        name = Sums(flat).of(start, end)
        size = np.diff(before)
        row = np.repeat(np.arange(len(size)), size)
        symbol, at = recompressed(name, row, self.rounds)
        length = np.minimum(np.append(at[1:], len(name)), before[1:][row[at]]) - at
        value = np.full(len(name), np.iinfo(np.int64).max)
        value[at] = (mix(symbol) >> np.uint64(6)).view(np.int64) | (self.longest - length) << 58
        inner = value[self.margin :]
        least = slide(inner, self.spread)[:n]
        row = row[:n]
        valid = np.arange(n) + self.window <= before[1:][row]
        new = np.ones(n, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
        place = np.flatnonzero(new)
        count = np.diff(np.append(place, n))
        tied = tied_runs(inner, least, valid, np.cumsum(new) - 1, len(place), self.spread)
        keep = valid[place]
        place, count, tied = place[keep], count[keep], tied[keep]
        sums = Sums(name)
        second: list[Sums] = []

        def names(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not second:
                second.append(Sums(name, 1))
            return tuple(s.of(at, at + self.window).view(np.int64) for s in (sums, second[0]))

        content = sums.of(place, place + count - 1 + self.window).view(np.int64)
        return Runs(row[place], place - before[row[place]], place, count, least[place], content, tied, names)

    def passages(self, flat: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the passages of some runs start and end (twice the start)."""
        first, last, before = words(flat, off)
        word = before[:-1][row] + start
        return first[word], last[word + count + self.window - 2], first[word]


def ordered_windows(window: int) -> Callable:
    def order(texts: pa.Array, lead: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of one key by their words."""
        flat, off = flat_bytes(texts)
        start, end, before = words(flat, off)
        each = gathered(flat, start, end)
        word = each.dictionary_encode().indices.to_numpy()  # equal words, equal numbers
        place = ragged(before[:-1], count)
        return multikey_order(np.repeat(lead, count), lambda j, i: word[place[i] + j], window)

    return order


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Each text without the words of windows that stand anywhere else too: ``id, n_words, spans, kept``.

    Words lie between ASCII white space. ``spans`` are the maximal removed runs of words (start, end, ...),
    ``kept`` the remaining words joined by one space. All copies lose the window, the first too; a repeated
    row counts as another place, with whatever id. A null or short text loses nothing; an empty table gives no
    rows; other columns are not read. Every row gives a row, of its own text only.
    """

    def cut(text: bytes, start: np.ndarray, end: np.ndarray):
        first, last, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        n = len(first)
        end = np.minimum(end - 1 + window, n)
        ok = start < end
        spans: list[int] = []
        for a, b in zip(start[ok].tolist(), end[ok].tolist()):
            if spans and a <= spans[-1]:
                spans[-1] = max(b, spans[-1])
            else:
                spans += [a, b]
        cuts = [0, *spans, n]
        kept = b" ".join(b" ".join(text[first[a] : last[b - 1]].split()) for a, b in zip(cuts[::2], cuts[1::2]) if a < b)
        return n, spans, kept.decode()

    return cut_repeats(docs, id_col, text_col, lambda: WordRuns(window, rounds), ordered_windows(window), False, False, cut, "n_words long, spans array<long>, kept string")
