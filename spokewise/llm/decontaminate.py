"""Benchmark decontamination over suffix arrays of the training documents.

Each shard of documents gets a suffix array of its words. Every suffix of every benchmark item is searched
in it by bisection, word after word, for all suffixes at once: the interval left after a window's words
holds all the places of that window, the last interval that isn't empty the longest verbatim match.

A shard's array holds the suffixes that start with a pair of neighbouring words of some item (or with a
whole one-word item). The others match no window, as every window of two words or more starts with such
a pair, so leaving them out changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stash
from .common import text_slices

WINDOW = 10
#: Words of benchmark items in one broadcast block; more items make more blocks, each searched in full.
BLOCK_WORDS = 500_000

#: Lower case for A-Z; every byte that is no ASCII letter or digit, below 128, becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class ItemBlock:
    """Some items, as one array of word numbers with a gap after each item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        flat: list[int] = []
        of, size = [], []
        for n, (_, words) in enumerate(items):
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            flat.append(0)
            of += [n] * (len(words) + 1)
            size += [min(window, len(words))] * (len(words) + 1)
        self.words = np.array(flat, dtype=np.int64)
        self.item = np.array(of, dtype=np.int64)
        self.window = np.array(size, dtype=np.int64)
        n = len(self.words)
        nxt = np.append(self.words[1:], 0)[:n]
        self.base = len(self.vocab) + 1
        self.pairs = np.unique((self.words * self.base + nxt)[(self.words > 0) & (nxt > 0)])
        self.ones = np.zeros(self.base, dtype=bool)
        self.ones[self.words[(self.window == 1) & (self.words > 0)]] = True
        self.longest = max((len(w) for _, w in items), default=0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers; 0 for a word of no item."""
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` ordered by the ``depth`` words from each on, by prefix doubling."""
    rank = np.zeros(len(words) + 1, dtype=np.int64)
    rank[:-1] = words
    order, step = at[np.argsort(words[at], kind="stable")], 1
    while step < depth and len(at):
        key = rank[at] * (rank.max() + 1) + rank[np.minimum(at + step, len(words))]
        values, dense = np.unique(key, return_inverse=True)
        rank[:] = 0
        rank[at] = dense + 1
        order = at[np.argsort(dense, kind="stable")]
        if len(values) == len(at):
            break
        step *= 2
    return order


def search(block: ItemBlock, words: np.ndarray, order: np.ndarray):
    """Places of every item's windows, ``(item, place, size)``, and the longest matches, ``(place, size)``."""
    padded = np.append(words, np.zeros(1, dtype=np.int64))
    top = len(words)
    suffix = np.flatnonzero(block.words > 0)
    lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(order), dtype=np.int64)
    hits, longest, depth = [], [], 0
    test = np.append(block.words, 0)
    while len(suffix):
        want = test[np.minimum(suffix + depth, len(test) - 1)]
        bounds = []
        for side in ("left", "right"):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                got = padded[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, top)]
                below = (got < want if side == "left" else got <= want) & open_
                a = np.where(below, mid + 1, a)
                b = np.where(open_ & ~below, mid, b)
            bounds.append(a)
        new_lo, new_hi = bounds
        ended = (new_lo >= new_hi) | (want == 0)
        for i in np.flatnonzero(ended & (depth >= block.window[suffix]) & (depth > 0)):
            longest.append((lo[i], hi[i], depth))
        suffix, lo, hi = suffix[~ended], new_lo[~ended], new_hi[~ended]
        depth += 1
        for i in np.flatnonzero(block.window[suffix] == depth):
            hits.append((block.item[suffix[i]], lo[i], hi[i], depth))
    return hits, longest


def judge(block: ItemBlock, texts: list[str | None]) -> list[tuple[int, list[int], list[str], int]]:
    """For each text: its words, the spans hit (start, end, start, end ...), the items, the longest match."""
    split = [words_of(x) for x in texts]
    size = np.array([len(w) + 1 for w in split], dtype=np.int64)
    starts = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.int64)
    for w, s in zip(split, starts):
        words[s : s + len(w)] = block.numbers(w)
    nxt = np.append(words[1:], 0)
    first = np.flatnonzero((words > 0) & (nxt > 0))
    key = words[first] * block.base + nxt[first]
    place = np.minimum(np.searchsorted(block.pairs, key), max(0, len(block.pairs) - 1))
    first = first[block.pairs[place] == key] if len(block.pairs) else first[:0]
    at = np.union1d(first, np.flatnonzero(block.ones[words]))
    tails = np.setdiff1d(first + 1, at)  # last words of runs: they start nothing, but are compared
    shown = np.zeros(len(words), dtype=np.int64)
    shown[at] = words[at]
    shown[tails] = words[tails]
    order = suffix_array(shown, np.union1d(at, tails), block.longest)
    hits, longest = search(block, shown, order) if len(order) else ([], [])
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    far = [0] * len(texts)
    for item, a, b, n in hits:
        places = order[a:b]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + n, -1)
        for d in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
            items[d].add(block.names[item])
    for a, b, n in longest:
        for d in np.unique(np.searchsorted(starts, order[a:b], "right") - 1).tolist():
            far[d] = max(far[d], n)
    hit = np.cumsum(edge)[:-1] > 0
    flips = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    owner = np.searchsorted(starts, flips[::2], "right") - 1
    spans: list[list[int]] = [[] for _ in texts]
    for d, a, b in zip(owner.tolist(), flips[::2].tolist(), flips[1::2].tolist()):
        spans[d] += [a - int(starts[d]), b - int(starts[d])]
    return [(len(w), s, sorted(i), f) for w, s, i, f in zip(split, spans, items, far)]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[ItemBlock]:
    """The items in blocks of at most ``most`` words (one item at least); the driver holds two at most."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    held, n = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        if words:
            if held and n + len(words) > most:
                yield ItemBlock(held, window)
                held, n = [], 0
            held.append((row.item, words))
            n += len(words)
    yield ItemBlock(held, window)


def with_end(blocks: Iterator[ItemBlock]) -> Iterator[tuple[ItemBlock, bool]]:
    """The blocks, each with whether it is the last one."""
    held = next(blocks)
    for b in blocks:
        yield held, False
        held = b
    yield held, True


def settled(found: DataFrame, step: DataFrame | None, block: Broadcast) -> tuple[DataFrame, DataFrame, None]:
    """``found`` written, after which neither the step before nor the block that it was found with is needed."""
    written = stash(found, "blocks")
    drop(step)
    block.destroy()
    return written, written, None


def merged(old: list[int], new: list[int]) -> list[int]:
    """The union of two lists of spans."""
    out: list[int] = []
    for a, b in sorted([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_FOUND = "n_words long, spans array<int>, items array<string>, longest int"


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where benchmark windows stand in each document: ``doc_id, n_words, spans, items, longest``.

    ``spans`` are maximal runs of hit words (start, end, ...), ``items`` the ids of items with a window there,
    sorted as strings, ``longest`` the words of the longest verbatim match of at least a window. One row for
    each row of ``docs``; a null or empty text has no words; an empty benchmark hits nothing; items without
    words or without an id are skipped; items of one id count once; other columns are not read. Documents
    are not shuffled; items reach the executors in blocks of at most ``block_words`` words, and
    none holds more than one: with more blocks, what was found is written before the next one is sent.
    """
    spark = docs.sparkSession
    found, step, held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None, None
    for k, (items, last) in enumerate(with_end(item_blocks(benchmark, item_col, item_text_col, window, block_words))):
        if k > 0:
            found, step, held = settled(found, step, held)
        block = held = spark.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch], block=block, first=k == 0, last=last) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, "text", 8 << 20):
                got = judge(block.value, b.column("text").to_pylist())
                if not first:
                    before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), b.column("longest").to_pylist())
                    got = [(n, merged(s0, s), sorted({*i0, *i}), max(l0, l)) for (n, s, i, l), (s0, i0, l0) in zip(got, before)]
                columns = {
                    "doc_id": b.column("doc_id"),
                    "text": b.column("text"),
                    "n_words": pa.array([g[0] for g in got], pa.int64()),
                    "spans": pa.array([g[1] for g in got], pa.list_(pa.int32())),
                    "items": pa.array([g[2] for g in got], pa.list_(pa.string())),
                    "longest": pa.array([g[3] for g in got], pa.int32()),
                }
                if last:
                    del columns["text"]
                yield pa.RecordBatch.from_pydict(columns)

        found = found.mapInArrow(rows, f"doc_id long, {'' if last else 'text string, '}{_FOUND}")
    return found


def hit_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`find_hits`."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "longest",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window stands."""
    spark = docs.sparkSession
    step = held = None
    for k, items in enumerate(item_blocks(benchmark, item_col, item_text_col, window, block_words)):
        if k > 0:
            docs, step, held = settled(docs, step, held)
        block = held = spark.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, text_col, 8 << 20):
                yield b.filter(pa.array([not g[1] for g in judge(block.value, b.column(text_col).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
