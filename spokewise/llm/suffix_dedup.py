"""Removal of long byte strings that stand earlier in the corpus, by sorted suffixes.

Suffixes are gathered where a 37-byte token, the smallest by hash of a window's 64, stands more than once;
a window without such a token has no copy. The suffixes of all windows that share such a token go to a bucket,
one range of leading tokens by splitters sampled from the tokens themselves. In a bucket passages of equal
bytes are taken together, and the suffixes of the windows of one passage each are put in order by multikey
sorting, 8 bytes a step, all ranges that are still open at once; a suffix that agrees with the one before it over
the whole window has an earlier copy. A border never parts a token, so equal windows never lie on two sides of
one. Tokens too frequent for one bucket are compared across buckets by 128-bit names of their windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import cut_repeats
from .windows import Sums, flat_bytes, picks, ragged, slide

WINDOW = 100


@dataclass
class Runs:
    """Neighbouring windows of one key: row, start in the row, place in the flat array, number of windows."""

    row: np.ndarray
    start: np.ndarray
    place: np.ndarray
    count: np.ndarray
    key: np.ndarray
    content: np.ndarray
    tied: np.ndarray
    names: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def no_runs() -> Runs:
    none = np.zeros(0, dtype=np.int64)
    return Runs(none, none, none, none, none, none, none.astype(bool), lambda at: (none, none))


def tied_runs(value: np.ndarray, least: np.ndarray, valid: np.ndarray, run_of: np.ndarray, n_runs: int, spread: int) -> np.ndarray:
    """Runs in which the smallest value may stand at two places, the only ones that can repeat within.

    ``value`` is the value of each place, ``least`` the smallest of each window's ``spread`` places.
    """
    low = np.iinfo(np.int64).min
    held = np.where(valid, least, low)
    most = slide(np.r_[np.full(spread - 1, low), held, np.full(spread - 1, low)], spread, np.maximum)
    anchor = np.flatnonzero(value[: len(most)] == most[: len(value)])
    twin = np.flatnonzero((np.diff(anchor) < spread) & (value[anchor[1:]] == value[anchor[:-1]]))
    mark = np.zeros(n_runs + 1, dtype=np.int64)
    if len(twin):
        last = len(run_of) - 1
        np.add.at(mark, run_of[np.clip(anchor[twin + 1] - spread + 1, 0, last)], 1)
        np.add.at(mark, run_of[np.clip(anchor[twin], 0, last)] + 1, -1)
    return np.cumsum(mark)[:-1] > 0


class ByteRuns:
    """Runs of byte windows; the key is the smallest hash of a window's tokens."""

    def __init__(self, window: int):
        self.window, self.spread = window, max(1, window - max(1, window * 3 // 8) + 1)
        self.token = window - self.spread + 1

    def __call__(self, flat: np.ndarray, off: np.ndarray) -> Runs:
        n = len(flat) - self.window + 1
        if n <= 0:
            return no_runs()
        sums = Sums(flat)
        value = picks(flat, self.token).view(np.int64)
        least = slide(value, self.spread)
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), size)[:n]
        valid = np.arange(n) + self.window <= off[1:][row]
        new = np.ones(n, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
        place = np.flatnonzero(new)
        count = np.diff(np.append(place, n))
        tied = tied_runs(value, least, valid, np.cumsum(new) - 1, len(place), self.spread)
        keep = valid[place]
        place, count, tied = place[keep], count[keep], tied[keep]
        second: list[Sums] = []

        def names(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not second:
                second.append(Sums(flat, 1))
            return tuple(s.of(at, at + self.window).view(np.int64) for s in (sums, second[0]))

        content = sums.of(place, place + count - 1 + self.window).view(np.int64)
        return Runs(row[place], place - off[row[place]], place, count, least[place], content, tied, names)

    def passages(self, flat: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the passages of some runs start and end, and where the token that their windows share starts."""
        place = off[:-1][row] + start
        if not len(place):
            return place, place, place
        value = picks(flat, self.token).view(np.int64)
        lead = place + (value[place[:, None] + np.arange(self.spread)] == key[:, None]).argmax(1)
        return place, place + count - 1 + self.window, lead


def multikey_order(lead: np.ndarray, token: Callable[[int, np.ndarray], np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by ``lead`` and then token after token, and which equal the one before.

    Every range of suffixes that agree so far is sorted by its next token and parted where that differs;
    ranges of one are done. All ranges of a depth are sorted in one call; equal suffixes keep their order.
    """
    order = np.argsort(lead, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = lead[order][1:] != lead[order][:-1]
    for j in range(depth):
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        part = np.cumsum(new[at])
        t = token(j, order[at])
        by = np.lexsort((t, part))
        order[at], t = order[at][by], t[by]
        new[at[1:]] |= t[1:] != t[:-1]
    return order, ~new


def ordered_windows(window: int) -> Callable:
    def order(texts: pa.Array, lead: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, off = flat_bytes(texts)
        place = ragged(off[:-1], count)
        step = min(8, window)
        at = [*range(0, window - step, step), window - step]
        view = np.lib.stride_tricks.sliding_window_view(np.r_[flat, np.zeros(8, dtype=np.uint8)], 8)
        mask = np.uint64(2**64 - 1) << np.uint64(8 * (8 - step))
        token = lambda j, i: np.ascontiguousarray(view[place[i] + at[j]]).view(">u8").ravel().astype(np.uint64) & mask
        return multikey_order(np.repeat(lead, count), token, len(at))

    return order


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each text without the bytes of windows that start earlier: ``id, n_bytes, spans, kept``.

    Earlier is a smaller id, or the same id and a smaller start. ``spans`` are the maximal removed runs (start,
    end, ...), ``kept`` the remaining bytes joined, which may part a letter. A null or short text loses nothing;
    an empty table gives no rows; other columns are not read. Every row gives a row. Rows that share an id are
    versions of one document: each loses its own windows, and of two that start at the same byte neither is
    earlier. A null id comes before all others.
    """

    def cut(text: bytes, start: np.ndarray, end: np.ndarray):
        end = np.minimum(end - 1 + window, len(text))
        ok = start < end
        spans: list[int] = []
        for a, b in zip(start[ok].tolist(), end[ok].tolist()):
            if spans and a <= spans[-1]:
                spans[-1] = max(b, spans[-1])
            else:
                spans += [a, b]
        cuts = [0, *spans, len(text)]
        return len(text), spans, b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))

    return cut_repeats(docs, id_col, text_col, lambda: ByteRuns(window), ordered_windows(window), True, True, cut, "n_bytes long, spans array<long>, kept binary")
