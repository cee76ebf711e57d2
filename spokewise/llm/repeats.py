"""Windows that stand more than once in a corpus, without a row for each window.

A finder cuts each document's windows into runs: neighbouring windows that share a key which their content
alone decides. So equal windows lie in runs of equal keys, and a run whose key stands nowhere else has no
repeated window. Runs meet by key in one shuffle, which tells the shared keys; the passages of their runs are
then cut from the texts, and meet once more. There texts decide: passages of equal bytes form a class, all of
whose windows are repeated, and the windows of one passage of each class are put in order and compared.

Runs of one task that agree in the 64-bit names of their key and their whole passage are sent once. The few keys with a large share
of all runs, found beforehand on an eighth of the documents, skip these meetings: their windows are sent instead,
named by 128 bits, which spread out. Which keys these are has no bearing on the result.

A document is an id with a hash of a text, so rows that share an id never mix up their texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stash
from .common import NULL_ID, ids_of, mix, pack_texts, text_slices, unpacked
from .windows import flat_bytes, groups, ragged

#: Kinds of rows; a run or window may carry the flags too.
TIED, TWICE, RUN, WINDOW, DONE, OPEN = 1, 2, 0, 4, 8, 16
#: Runs that a task settles together, and rows of a sorted partition that it holds at a time.
SETTLED, HELD = 400_000, 400_000
#: Bytes of texts, about, from which a task cuts passages at a time.
HELD_BYTES = 2 << 20
#: One document in so many is looked at for keys with a large share of all runs, and a quarter of those for
#: splitters, of which each bucket has so many leads sampled.
LOOK, PER_BUCKET = 8, 100

_ROW = "kind int, k1 long, k2 long, doc long, v long, at long"

_PASSAGE = "bucket int, k1 long, tied int, doc long, v long, at long, passage binary"


def pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 31 | count.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 31, at & (2**31 - 1)


def batch(kind, k1, k2, doc, v, at) -> pa.RecordBatch:
    n = len(at)
    full = lambda x: np.full(n, x) if np.isscalar(x) else x
    return pa.RecordBatch.from_arrays([pa.array(full(kind).astype(np.int32)), *(pa.array(full(c).astype(np.int64)) for c in (k1, k2, doc, v, at))], ["kind", "k1", "k2", "doc", "v", "at"])


def joined(doc: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one document that touch or overlap, as one."""
    start, count = unpack(at)
    order = np.lexsort((start, v, doc))
    doc, v, start, end = doc[order], v[order], start[order], (start + count)[order]
    if not len(doc):
        return doc, v, at
    new = np.r_[True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])]
    # ends made to rise from document to document, for one running maximum
    lift = np.cumsum(new) * np.int64(2**33)
    reach = np.maximum.accumulate(end + lift)
    cut = new | np.r_[True, (start + lift)[1:] > reach[:-1]]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], v[first], pack(start[first], (reach - lift)[last] - start[first])


def settled(rows: dict[str, np.ndarray], classes: list[np.ndarray], keep_first: bool) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The rows of each class that go on, and those that are repeated for sure.

    With ``keep_first`` the first by document and start goes on, with any other that has both in common; without,
    one row of each class."""
    order = np.lexsort((rows["at"], rows["doc"], *classes))
    rows = {k: x[order] for k, x in rows.items()}
    first = np.ones(len(order), dtype=bool)
    for c in classes:
        first[1:] &= c[order][1:] == c[order][:-1]
    first = ~first
    first[:1] = True
    at = np.flatnonzero(first)
    if not len(at):
        return rows, rows
    size = np.diff(np.append(at, len(order)))
    if keep_first:
        lead = np.repeat(at, size)
        again = (rows["doc"] != rows["doc"][lead]) | (rows["at"] != rows["at"][lead])
        go = ~again
    else:
        again, go = np.repeat(size > 1, size), first
    repeated = {k: x[again] for k, x in rows.items()}
    flags = np.repeat(np.bitwise_or.reduceat(rows["kind"], at), size)
    return {k: x[go] for k, x in (rows | {"kind": flags}).items()}, repeated


def done(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Repeated windows as stretches of their documents; dealt out by document."""
    doc, v, at = joined(rows["doc"], rows["v"], rows["at"])
    return batch(DONE, mix(doc.view(np.uint64) ^ v.view(np.uint64)).view(np.int64), 0, doc, v, at)


def hot_keys(rows: DataFrame, finder: Callable, share: int) -> list[int]:
    """Keys with at least one in ``share`` of the runs looked at: at most ``share`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, keys, contents = finder(), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for b in text_slices(batches, "text", 1 << 20):
            found = find(*flat_bytes(b.column("text")))
            keys.append(found.key)
            contents.append(found.content)
        k, c = np.concatenate(keys), np.concatenate(contents)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(k)]
        values, n = np.unique(k[new], return_counts=True)
        often = n >= max(2, n.sum() // (2 * share))
        yield pa.RecordBatch.from_arrays([pa.array([*values[often].tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())], ["key", "n"])

    some = rows.where(F.crc32(F.col("doc").cast("string").cast("binary")) % LOOK == 0)
    top = some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(share + 1).collect()
    total = next((r.n for r in top if r.key is None), 0)
    return [r.key for r in top if r.key is not None and r.n * share >= total]


def splitters(leads: DataFrame, parts: int) -> np.ndarray:
    """Borders of ``parts`` ranges of leading tokens, by rows ``lead``: at most ``PER_BUCKET`` of them for each range
    come to the driver."""
    some = sorted(leads.orderBy(F.rand(7)).limit(PER_BUCKET * parts).toArrow()["lead"].to_pylist())
    return np.array(sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else [], dtype=bytes)


def gathered(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of a flat array as binary values."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    held = np.ascontiguousarray(flat[ragged(start, end - start)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def repeated_stretches(docs: DataFrame, finder: Callable, order: Callable, keep_first: bool, by_range: bool) -> tuple[DataFrame, DataFrame]:
    """``doc, v, at`` of stretches of repeated windows (packed: first window, number of them), and the packed texts.

    ``docs``: ``doc long, v long, text string``. ``finder()`` gives a function from bytes and row starts to runs;
    ``order`` puts the windows of some passages in order and says which equal the one before. With ``by_range``
    passages meet in buckets of a range of leads, else by a hash of the lead.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(np.array(sorted(hot_keys(docs, finder, min(50_000, max(400, 2 * parts)))), dtype=np.int64))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        held: dict[int, list[dict[str, np.ndarray]]] = {RUN: [], WINDOW: []}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            rows = {k: np.concatenate([h[k] for h in held[kind]]) for k in held[kind][0]}
            held[kind].clear()
            one, repeated = settled(rows, [rows["k1"], rows["k2"]], keep_first)
            yield done(repeated)
            yield batch(one["kind"], one["k1"], one["k2"] if kind == WINDOW else 0, one["doc"], one["v"], one["at"])

        for b in text_slices(batches, "text", 1 << 20):
            found = find(*flat_bytes(b.column("text")))
            doc, v = ids_of(b)[found.row], b.column("v").to_numpy()[found.row]
            rows = {"kind": np.where(found.tied, RUN | TIED, RUN), "k1": found.key, "k2": found.content, "doc": doc, "v": v, "at": pack(found.start, found.count)}
            if len(hot.value):
                is_hot = np.isin(found.key, hot.value)
                if is_hot.any():
                    n = found.count[is_hot]
                    w1, w2 = found.names(ragged(found.place[is_hot], n))
                    at = pack(ragged(found.start[is_hot], n), np.ones(int(n.sum()), dtype=np.int64))
                    held[WINDOW].append({"kind": np.full(len(at), WINDOW), "k1": w1, "k2": w2, "doc": np.repeat(doc[is_hot], n), "v": np.repeat(v[is_hot], n), "at": at})
                    rows = {k: x[~is_hot] for k, x in rows.items()}
            held[RUN].append(rows)
            for kind, own in held.items():
                if own and sum(len(h["at"]) for h in own) >= SETTLED:
                    yield from flush(kind)
        for kind, own in held.items():
            if own:
                yield from flush(kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k1", HELD):
            rows = {k: t.column(k).to_numpy() for k in t.column_names}
            of = lambda some: {k: x[some] for k, x in rows.items()}
            kind = rows["kind"] & ~(TIED | TWICE)
            ready = of(kind == DONE)
            yield batch(DONE, 0, 0, ready["doc"], ready["v"], ready["at"])
            windows = of(kind == WINDOW)
            yield done(settled(windows, [windows["k1"], windows["k2"]], keep_first)[1])
            own = of(kind == RUN)
            by_key = np.argsort(own["k1"], kind="stable")
            own = {k: x[by_key] for k, x in own.items()}
            key = own["k1"]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            size = np.diff(np.append(at, len(key)))
            asked = np.repeat(size > 1, size) | (own["kind"] & TIED > 0)
            yield batch(OPEN, key[asked], own["kind"][asked] & TIED, own["doc"][asked], own["v"][asked], own["at"][asked])

    found = docs.mapInArrow(runs, _ROW).repartition("k1").sortWithinPartitions("k1").mapInArrow(meet, _ROW)
    found = stash(found, "runs")
    packed = docs.mapInArrow(pack_texts, "doc long, v long, z binary")

    def passages(batches: Iterator[pa.RecordBatch], borders: np.ndarray, only_leads: bool = False) -> Iterator[pa.RecordBatch]:
        find = finder()
        for b in batches:
            sizes = np.diff(b.column("asked").offsets.to_numpy())
            weight = 64 * sizes + 3 * np.diff(flat_bytes(b.column("z"))[1])  # what is held: 64 places of a run, a text's hashes
            part = np.cumsum(weight) // HELD_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                piece = b.slice(x, y - x)
                asked = piece.column("asked").flatten()
                k1, tied, at = (asked.field(c).to_numpy() for c in ("k1", "k2", "at"))
                row = np.repeat(np.arange(y - x), sizes[x:y])
                texts = [unpacked(z) for z in piece.column("z")]
                flat, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
                start, end, lead = find.passages(flat, off, row, *unpack(at), k1)
                if only_leads:
                    yield pa.RecordBatch.from_arrays([gathered(flat, lead, lead + find.token).cast(pa.binary())], ["lead"])
                    continue
                bucket = np.zeros(len(row), dtype=np.int64)
                if len(borders):
                    bucket = np.searchsorted(borders, np.ascontiguousarray(flat[lead[:, None] + np.arange(find.token)]).view(f"S{find.token}").ravel(), "right")
                own = [piece.column(c).take(pa.array(row)) for c in ("doc", "v")]
                columns = [pa.array(bucket.astype(np.int32)), pa.array(k1), pa.array(tied.astype(np.int32)), *own, pa.array(at), gathered(flat, start, end).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "k1", "tied", "doc", "v", "at", "passage"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k1", HELD // 20):
            rows = {k: t.column(k).to_numpy() for k in ("doc", "v", "at")}
            rows["kind"] = np.zeros(len(rows["at"]), dtype=np.int64)
            rows["row"] = np.arange(len(rows["at"]))
            column = t.column("passage").combine_chunks()
            k1 = t.column("k1").to_numpy()
            lead = np.cumsum(np.r_[True, k1[1:] != k1[:-1]][: len(k1)]) - 1
            alike = column.dictionary_encode().indices.to_numpy()  # passages of equal bytes
            one, repeated = settled(rows, [alike], keep_first)
            yield done(repeated)
            # a lead with one passage that can't repeat within has nothing to compare
            kinds = np.bincount(lead[one["row"]][np.r_[True, np.diff(alike[one["row"]]) != 0][: len(one["row"])]], minlength=int(lead.max(initial=0)) + 1)
            loose = np.bincount(lead, weights=t.column("tied").to_numpy() != 0, minlength=len(kinds)) > 0
            some = ((kinds > 1) | loose)[lead[one["row"]]]
            one = {k: x[some] for k, x in one.items()}
            by_place = np.lexsort((one["at"], one["doc"], lead[one["row"]]))  # so that equal windows stay in document order
            one = {k: x[by_place] for k, x in one.items()}
            start, count = unpack(one["at"])
            row, own = np.repeat(np.arange(len(start)), count), ragged(start, count)
            placed, same = order(column.take(pa.array(one["row"])), lead[one["row"]], count)
            row, own = row[placed], own[placed]
            if keep_first:  # not those at the very place of the first
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                again = same & ((one["doc"][row] != one["doc"][row[first]]) | (own != own[first]))
            else:
                again = same | np.append(same[1:], np.zeros(min(1, len(same)), dtype=bool))
            yield done({"doc": one["doc"][row[again]], "v": one["v"][row[again]], "at": pack(own[again], np.ones(int(again.sum()), dtype=np.int64))})

    def asked_of(texts: DataFrame, some: DataFrame) -> DataFrame:
        return texts.join(some.groupBy("doc", "v").agg(F.collect_list(F.struct("k1", "k2", "at")).alias("asked")), ["doc", "v"])

    asked = found.where(F.col("kind") == OPEN).select("k1", "k2", "doc", "v", "at")
    borders = np.array([], dtype=bytes)
    if by_range:
        # equal leads are never parted, so no window has an equal one across a border
        some = F.pmod(F.xxhash64("doc", "v"), F.lit(LOOK * 4)) == 0
        few = docs.where(some).mapInArrow(pack_texts, "doc long, v long, z binary")
        borders = splitters(asked_of(few, asked.where(some)).mapInArrow(lambda b: passages(b, borders, True), "lead binary"), parts)
    met = asked_of(packed, asked).mapInArrow(lambda b: passages(b, borders), _PASSAGE)
    met = met.repartitionById(parts, "bucket") if by_range else met.repartition("k1")
    compared = met.sortWithinPartitions("k1").mapInArrow(compare, _ROW)
    return found.where(F.col("kind") == DONE).select("doc", "v", "at").unionByName(compared.select("doc", "v", "at")), packed


def cut_repeats(docs: DataFrame, id_col: str, text_col: str, finder: Callable, order: Callable, keep_first: bool, by_range: bool, cut: Callable, schema: str) -> DataFrame:
    """Each row's text without its repeated windows, as ``cut(text, stretches)`` makes it.

    ``cut`` takes the bytes of a text, and starts and ends of its stretches of repeated windows.
    """
    text = F.col(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("v"), text.alias("text"))
    stretches, packed = repeated_stretches(rows, finder, order, keep_first, by_range)
    by_doc = stretches.groupBy("doc", "v").agg(F.collect_list("at").alias("ats"))
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if " long" in f and "array" not in f else pa.list_(pa.int64()) if "array" in f else pa.string() if " string" in f else pa.binary() for f in schema.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = ids_of(b)
            out: list[list] = [[] for _ in names]
            held = 0
            ids: list = []
            for i, z, ats in zip(doc.tolist(), b.column("z"), b.column("ats")):
                text = unpacked(z)
                at = np.array(ats.as_py() if ats.is_valid else [], dtype=np.int64)
                none = np.zeros(len(at), dtype=np.int64)
                start, count = unpack(joined(none, none, at)[2])
                for column, value in zip(out, cut(text, start, start + count)):
                    column.append(value)
                ids.append(i if i != NULL_ID else None)
                held += len(text)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, out, types)], ["id", *names])
                    out, ids, held = [[] for _ in names], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, out, types)], ["id", *names])

    return packed.join(by_doc, ["doc", "v"], "left").mapInArrow(finish, f"id long, {schema}")
