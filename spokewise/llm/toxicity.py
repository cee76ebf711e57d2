"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel compares strings by the three-letter subsequences they share, each weighted by a decay to the
power of the letters it spans, up to a bounded span; so an insult with inserted letters keeps most of its
subsequences. Strings are words in lower case without outer punctuation; single letters in a row are read as
one word with its gaps. A sentence counts as its strongest word does, a text as its strongest sentence.

Training labels stand at documents: sentences of clean ones are clean, and of a toxic one the sentence with
the strongest word is its witness, chosen anew in each round. The support vector machine works in the
Nyström space of some landmark words. As it is linear there, its landmarks fold into one weight for each
subsequence, and scoring a word is a sum over its own subsequences: the model is one table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .windows import Sums, flat_bytes, ragged, words

#: Letters spanned by a subsequence at most, and the decay for each.
SPAN, DECAY = 6, 0.7
#: Labelled texts that are fitted: toxic and clean ones at most, and their bytes at most.
TOXIC_ROWS, CLEAN_ROWS, ROW_BYTES = 1_500, 5_000, 40_000
LANDMARKS, ROUNDS, RIDGE = 200, 5, 3e-4
#: Log odds of a first witness, standard errors between its shares, and the share of toxic texts that hold it.
TELLING, SURE, SHARE = 2.0, 3.5, 0.02
#: Copies of each witness with a letter put in, for training.
COPIES = 5
#: Letters of training texts that are looked at together, one text at least.
PART = 100_000
#: Letters of a word that are looked at together; longer words are looked at in overlapping stretches.
STRETCH = 24

_GAPS = [(d, e) for e in range(2, SPAN) for d in range(1, e)]
#: Letters a-z, digits, bytes from 128 on, a word's border (62), and the rest; 0 stands for no letter.
_CLASS = np.full(256, 63, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = np.arange(27, 37)
_CLASS[128:] = 37 + np.arange(128) % 25
_OUTER = _CLASS == 63


def length_norm() -> np.ndarray:
    n = np.arange(STRETCH + 3)
    squares = sum(np.maximum(0, n - e) * DECAY ** (2 * (e + 1)) for _, e in _GAPS)
    return np.sqrt(np.maximum(squares, 1e-12))


_NORM = length_norm()


def unit_places(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each string to be judged."""
    start, end, before = words(flat, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(before))
    inner = np.flatnonzero(~_OUTER[flat])  # without outer punctuation
    first, last = np.searchsorted(inner, start), np.searchsorted(inner, end)
    some = first < last
    start, end, row = inner[first[some]], inner[last[some] - 1] + 1, row[some]
    one = end - start == 1
    glued = np.zeros(len(one), dtype=bool)
    glued[1:] = one[1:] & one[:-1] & (row[1:] == row[:-1])
    head = np.flatnonzero(~glued)
    last = np.append(head[1:], len(one)) - 1
    start, end, row = start[head], end[last] if len(head) else end[:0], row[head]
    long = end - start > STRETCH
    if long.any():
        step = STRETCH // 2
        n = np.where(long, -(-(end - start - STRETCH) // step) + 1, 1)
        begin = ragged(np.zeros(len(n), dtype=np.int64), n) * step
        start, end, row = np.repeat(start, n) + begin, np.repeat(end, n), np.repeat(row, n)
        end = np.minimum(end, start + STRETCH)
    return start, end, row


def letters(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Letter classes between two borders, one string a row, padded with 0."""
    at = start[:, None] + np.arange(-1, STRETCH + 1)
    inside = (at >= start[:, None]) & (at < end[:, None])
    border = (at == start[:, None] - 1) | (at == end[:, None])
    return np.where(inside, _CLASS[flat[np.clip(at, 0, len(flat) - 1)]], np.where(border, 62, 0)).astype(np.uint8)


def subsequences(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: the subsequences at each place, which of them exist, and their weight."""
    m = m.astype(np.int32)
    for d, e in _GAPS:
        yield m[:, :-e] << 12 | m[:, d : m.shape[1] - e + d] << 6 | m[:, e:], m[:, e:] > 0, DECAY ** (e + 1)


def folded(m: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of each string's weighted subsequences in ``table``, by its norm."""
    total = np.zeros(len(m))
    for code, ok, weight in subsequences(m):
        total += weight * np.where(ok, table[code], 0).sum(1)
    return total / _NORM[(m > 0).sum(1)]


def features(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences of all strings: their codes, whose they are, and their weights."""
    codes, rows, weights = [], [], []
    for code, ok, weight in subsequences(m):
        r, c = np.nonzero(ok)
        codes.append(code[r, c])
        rows.append(r)
        weights.append(np.full(len(r), weight))
    return np.concatenate(codes), np.concatenate(rows), np.concatenate(weights) / _NORM[(m > 0).sum(1)][np.concatenate(rows)]


@dataclass
class Model:
    table: np.ndarray  # a weight for each subsequence
    bias: float
    slope: float  # of the chance that a margin means label 1
    shift: float

    def margins(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The strongest margin of each text; that of no word where there is none."""
        out = np.full(len(off) - 1, -np.inf)
        start, end, row = unit_places(flat, off)
        if len(start):
            name = Sums(flat).of(start, end)
            _, at, back = np.unique(name, return_index=True, return_inverse=True)
            value = np.concatenate([folded(letters(flat, start[a], end[a]), self.table) for a in np.array_split(at, 1 + len(at) // 20_000)])[back]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.maximum.reduceat(value, first)
        return np.where(np.isfinite(out), out + self.bias, self.bias)

    def scores(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, off) + self.shift, -40, 40)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = y * (x @ w) < 1
        near, t = x[inside], y[inside]
        a = near * weight[inside, None]
        hold = ridge * weight.sum() * np.eye(len(w))
        hold[-1, -1] *= 1e-3
        new = np.linalg.solve(a.T @ near + hold, a.T @ t)
        del near, a
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def inserted(m: np.ndarray, copies: int) -> np.ndarray:
    """Copies of the strings, each with one letter put in at a place of its own."""
    rng = np.random.default_rng(5)
    m = np.tile(m, (copies, 1))
    size = (m > 0).sum(1)
    at = rng.integers(2, np.maximum(3, size - 1))[:, None]
    letter = rng.choice(np.unique(_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz-.*", np.uint8)]), len(m))[:, None]
    place = np.arange(m.shape[1])[None, :]
    moved = np.c_[m[:, :1], m[:, :-1]]
    return np.where(place < at, m, np.where(place == at, letter, moved)).astype(np.uint8)


def words_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words each text has, as pairs in order of the texts, and the letters of all words."""
    rows, names, known, shapes = [], [], np.zeros(0, dtype=np.uint64), np.zeros((0, STRETCH + 2), dtype=np.uint8)
    part = np.cumsum([len(t) for t in texts]) // PART  # long texts make short parts, as each letter takes many bytes below
    for k, end in zip(cuts := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cuts[1:], len(texts)]):
        flat, off = flat_bytes(pa.array(texts[k:end], pa.string()))
        start, end, row = unit_places(flat, off)
        name = Sums(flat).of(start, end)
        order = np.lexsort((name, row))
        name_, row_ = name[order], row[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (name_[1:] != name_[:-1]) | (row_[1:] != row_[:-1])
        rows.append((row_[new] + k).astype(np.int32))
        names.append(name_[new])
        own, at = np.unique(name, return_index=True)
        place = np.searchsorted(known, own)
        fresh = np.searchsorted(known, own, "right") == place  # each word's letters are kept once
        known, shapes = np.insert(known, place[fresh], own[fresh]), np.insert(shapes, place[fresh], letters(flat, start[at[fresh]], end[at[fresh]]), axis=0)
    return np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate([np.searchsorted(known, x).astype(np.int32) for x in names] or [np.zeros(0, np.int32)]), shapes


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of some labelled texts; of one label only, a constant score of that label's share."""
    y = np.array(toxic, dtype=np.int64)
    row, word, m = words_of_texts(texts)
    if not len(row) or len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << 18, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    in_toxic = np.bincount(word[y[row] == 1], minlength=len(m))
    in_clean = np.bincount(word[y[row] == 0], minlength=len(m))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((in_toxic + 0.1) / (n1 + 0.2)) - np.log((in_clean + 0.1) / (n0 + 0.2))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    cuts = np.append(first, len(row))

    def strongest(value: np.ndarray) -> np.ndarray:
        """The best-valued word of each text with words."""
        return np.array([word[a + np.argmax(value[word[a:b]])] for a, b in zip(cuts[:-1], cuts[1:])])

    who = y[row[first]]
    # the first witnesses: words of a fair share of the toxic texts that clean ones hardly have
    both = (in_toxic + in_clean) / len(y)
    sure = (in_toxic / n1 - in_clean / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    telling = np.flatnonzero((odds > TELLING) & (sure > SURE) & (in_toxic >= SHARE * n1))
    top = strongest(odds * np.sqrt(in_toxic))
    witness, rival = telling if len(telling) else np.unique(top[who == 1]), top[who == 0]
    chosen = witness[np.argsort(-in_toxic[witness], kind="stable")][: LANDMARKS * 3 // 4]
    usual = np.argsort(-in_clean, kind="stable")[: LANDMARKS - len(chosen)]
    marks = np.unique(np.r_[chosen, usual])
    code, owner, weight = features(m[marks])
    known, column = np.unique(code, return_inverse=True)
    column_of = np.full(1 << 18, -1)
    column_of[known] = np.arange(len(known))
    phi = np.zeros((len(marks), len(known)))
    np.add.at(phi, (owner, column), weight)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])

    def placed(m: np.ndarray) -> np.ndarray:
        """The strings in the Nyström space."""
        out = []
        for part in np.array_split(m, 1 + len(m) // 1_000):
            code, owner, weight = features(part)
            some = column_of[code] >= 0
            shared = np.zeros((len(part), len(known)))
            np.add.at(shared, (owner[some], column_of[code[some]]), weight[some])
            out.append(shared @ phi.T @ whiten)
        return np.concatenate(out)

    rng = np.random.default_rng(3)
    clean_words = np.flatnonzero(in_clean)
    others = rng.permutation(clean_words)[:6_000]
    rivals = np.unique(np.r_[rival, others])
    for step in range(ROUNDS):
        n = len(witness)
        t = np.r_[np.ones((1 + COPIES) * n), -np.ones(len(rivals))]
        weight = np.r_[np.full(n, 0.5 / n), np.full(COPIES * n, 0.5 / (COPIES * n)), np.full(len(rivals), 1 / len(rivals))]
        w, bias = svm(np.r_[placed(m[witness]), placed(inserted(m[witness], COPIES)), placed(m[rivals])], t, weight, RIDGE)
        table = np.zeros(1 << 18, dtype=np.float32)
        table[known] = (whiten @ w) @ phi
        value = np.concatenate([folded(p, table) for p in np.array_split(m, 1 + len(m) // 20_000)]) + bias
        best = strongest(value)
        margin = value[best]
        if step + 1 < ROUNDS:
            own = best[who == 1]  # witnesses of texts without one so far, if others share them
            witness = np.union1d(witness, own[(margin[who == 1] < 1) & (in_toxic[own] >= 2) & (odds[own] > TELLING)])
            rivals = np.unique(np.r_[rivals, best[who == 0], clean_words[np.argsort(-value[clean_words], kind="stable")[:2_000]]])
    # chances from margins, by a few Newton steps; toxic texts in which no word was found tell nothing
    told = (who == 0) | (margin > 0)
    who, margin = who[told], margin[told]
    x = np.c_[margin, np.ones(len(margin))]
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hold = 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (who - p) - hold @ w), -5, 5)
    return Model(table, bias, float(max(w[0], 0)), float(w[1]))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, row_bytes: int = ROW_BYTES) -> Model:
    """The model fitted to a bounded sample of labelled rows, by a hash of their ids.

    ``held_out`` (over the labels' columns) says which labels may not be used. Null ids, labels and texts, ids
    labelled both ways, and texts over ``row_bytes``, are not fitted; of several texts of one id the smallest is.
    """
    some = labels.where(~held_out & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    some = some.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    parts = [some.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    ids = {r.id: r.y for p in parts for r in p.collect()}
    if not ids:
        return fit([], [])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), "id long, y int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id").where(F.octet_length("text").between(1, row_bytes)).groupBy("id", "y").agg(F.min("text").alias("text"))
    made = texts.repartition(1).mapInArrow(fitted, "weights binary, bias double, slope double, shift double").first()
    return fit([], []) if made is None else Model(np.frombuffer(made.weights, dtype=np.float32), made.bias, made.slope, made.shift)


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of one task's rows ``id, y, text``, a bounded sample, as one row: the driver gets no texts and holds
    nothing of the fit."""
    rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("id", "text", "y"))))
    model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
    yield pa.RecordBatch.from_pylist([{"weights": model.table.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}], pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())]))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every whole text; a null or wordless text has the score of no evidence.

    One row for each row; an empty table gives no rows; other columns are not read; nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(held.value.scores(*flat_bytes(b.column("text"))))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, "id long, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col, 1 << 19):
            yield b.filter(pa.array(held.value.scores(*flat_bytes(b.column(text_col))) < least))

    return docs.mapInArrow(rows, docs.schema)
