"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of rare lines: a line that at most ``RARE`` texts hold makes
a pair of any two of them. Each pair's whole line sequences are aligned by patience diff, and the aligned common
blocks are deleted from the later document. Equal texts are one vertex, so copies make no pairs.

A line that more texts hold makes no pairs of all its holders, which would be the square of their number; each of
them is paired with the first one instead. Stretches of 2, 4, 8, ... lines that are all so common are looked at
in the same way: one that at most ``RARE`` texts hold makes a pair of any two, another leads to its first holder.
So every line that stands in an earlier document leads to a partner, and a stretch of common lines leads to those
that hold it in the same order. The number of pairs is linear in the corpus's lines.

Only the hashes of lines take part in the search and the alignment, and of those only of lines that stand in two
texts at least; places are kept, so an unshared line still parts the blocks around it. Texts are read once for
the hashes and once for the deletion.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stash
from .common import NULL_ID, join_groups, mix, text_slices
from .windows import _SPACE, Sums, flat_bytes

#: Texts that may hold a line for it to pair all of them.
RARE = 6
_BREAK, _BLANK = 10, " \t\n\v\f\r"
_GONE, _COPY = "__line_gone", "__line_copy"


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line, odd if the line is more than white space; and where each row's lines start."""
    flat, off = flat_bytes(column)
    n = len(off) - 1
    breaks = np.flatnonzero(flat == _BREAK)
    row = np.searchsorted(off, breaks, "right") - 1
    lines = np.r_[0, np.cumsum(np.bincount(row, minlength=n) + 1)]
    is_first = np.zeros(lines[-1], dtype=bool)
    is_first[lines[:-1]] = True
    is_last = np.zeros(lines[-1], dtype=bool)
    is_last[lines[1:] - 1] = True
    start = np.empty(lines[-1], dtype=np.int64)
    end = np.empty(lines[-1], dtype=np.int64)
    start[is_first], start[~is_first] = off[:-1], breaks + 1
    end[is_last], end[~is_last] = off[1:], breaks
    signs = np.r_[0, np.cumsum(~_SPACE[flat])]
    value = Sums(flat).of(start, end)
    return (value & ~np.uint64(1) | (signs[end] > signs[start])).view(np.int64), lines


def common_stretches(place: np.ndarray, line: np.ndarray, common: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of each stretch of 2, 4, 8, ... neighbouring lines that are all common, and not all blank."""
    n = len(line)
    if not n:
        return
    sums = Sums(line.view(np.uint64))
    full = np.r_[0, np.cumsum(line & 1)]
    cut = np.ones(n, dtype=bool)
    cut[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | ~common[:-1] | ~common[1:]
    first = np.flatnonzero(cut)
    left = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) - np.arange(n)  # lines to the end of the stretch
    span = 2
    while True:
        at = np.flatnonzero(left >= span)
        if not len(at):
            return
        at = at[full[at + span] > full[at]]
        yield row[at], mix(sums.of(at, at + span) + np.uint64(span)).view(np.int64)
        span *= 2


def patience(a: list[int], at_a: list[int], n_a: int, b: list[int], at_b: list[int], n_b: int) -> list[tuple[int, int]]:
    """Indices in ``a`` and ``b`` that patience diff aligns: equal ends, then lines unique on both sides in
    their longest common order, and the same again between those.

    ``a`` holds the lines, of a sequence of ``n_a``, that another text may share, ``at_a`` their places; the
    lines left out are met by none. So for ``b``."""
    found: list[tuple[int, int]] = []
    # bounds: indices into the lists, and the places just before and after
    todo = [(0, len(a), 0, len(b), -1, -1, n_a, n_b)]
    while todo:
        a0, a1, b0, b1, la, lb, ra, rb = todo.pop()
        while a0 < a1 and b0 < b1 and at_a[a0] == la + 1 and at_b[b0] == lb + 1 and a[a0] == b[b0]:
            found.append((a0, b0))
            la, lb = la + 1, lb + 1
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and at_a[a1 - 1] == ra - 1 and at_b[b1 - 1] == rb - 1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            ra, rb = ra - 1, rb - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a: dict[int, int] = {}
        for i in range(a0, a1):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict[int, int] = {}
        for j in range(b0, b1):
            if once_a.get(b[j], -1) >= 0:
                once_b[b[j]] = -1 if b[j] in once_b else j
        both = sorted((j, once_a[x]) for x, j in once_b.items() if j >= 0)
        ends: list[int] = []
        last: list[int] = []
        back = [-1] * len(both)
        for k, (_, i) in enumerate(both):
            at = bisect_left(ends, i)
            back[k] = last[at - 1] if at else -1
            if at == len(ends):
                ends.append(i)
                last.append(k)
            else:
                ends[at], last[at] = i, k
        chain: list[tuple[int, int]] = []
        k = last[-1] if last else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        if not chain:
            continue
        pa_, pb = a0, b0
        for j, i in reversed(chain):
            todo.append((pa_, i, pb, j, la, lb, at_a[i], at_b[j]))
            found.append((i, j))
            pa_, pb, la, lb = i + 1, j + 1, at_a[i], at_b[j]
        todo.append((pa_, a1, pb, b1, la, lb, ra, rb))
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text", 1 << 20):
        line, lines = line_hashes(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("v"), b.column("w"), pa.ListArray.from_arrays(pa.array(lines.astype(np.int32)), pa.array(line))], ["doc", "v", "w", "lines"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = b.column("line")
        row = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
        flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        for row, stretch in common_stretches(flat("place"), flat("line"), flat("common"), row):
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(rows), b.column("v").take(rows), pa.array(stretch)], ["doc", "v", "key"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which places of each document are deleted for each partner; the partner's lines come before the documents'."""
    held: tuple[int, int] | None = None
    partners: list[tuple[list[int], list[int], int]] = []
    for b in batches:
        docs, vs, gone = [], [], []
        columns = [b.column(c) for c in ("partner", "salt", "side", "doc", "v", "n_lines")]
        for partner, salt, side, doc, v, n, place, line in zip(*(c.to_pylist() for c in columns), b.column("place"), b.column("line")):
            if (partner, salt) != held:
                held, partners = (partner, salt), []
            place, line = place.as_py(), line.as_py()
            if side == 0:
                partners.append((line, place, n))
                continue
            lost: list[int] = []
            for own in partners:
                block: list[int] = []
                full, i0, j0 = 0, -2, -2
                for i, j in sorted((own[1][i], j) for i, j in patience(*own, line, place, n)):
                    if i != i0 + 1 or place[j] != j0 + 1:
                        lost += block if full else []
                        block, full = [], 0
                    i0, j0 = i, place[j]
                    block.append(j0)
                    full |= line[j] & 1
                lost += block if full else []
            if lost:
                docs.append(doc)
                vs.append(v)
                gone.append(lost)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(vs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc", "v", "gone"])


def partners(held: DataFrame, rare: int) -> DataFrame:
    """``doc, v, partner``: earlier documents that share a key, by rows ``key, doc, v`` (once each).

    All of a key with at most ``rare`` holders, and the first of another one."""
    keys = stash(held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1"), "keys")
    shared = join_groups(held, keys, ["key"])
    few = shared.where(F.col("n") <= rare).groupBy("key").agg(F.collect_list(F.struct("doc", "v")).alias("all"))
    few = few.select("all", F.explode("all").alias("own")).select("own.doc", "own.v", F.explode("all.doc").alias("partner"))
    many = shared.where(F.col("n") > rare).select("doc", "v", F.col("first").alias("partner"))
    return few.unionByName(many).where("partner < doc").distinct()


def deleted_places(vertices: DataFrame, rare: int) -> DataFrame:
    """``doc, v, gone`` of distinct texts ``doc, v, lines`` that share a block with an earlier one."""
    lines = vertices.select("doc", "v", F.explode(F.array_distinct("lines")).alias("key"))
    known = stash(lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lines")
    shared = join_groups(vertices.select("doc", "v", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "key")), known, ["key"])
    each = F.array_sort(F.collect_list(F.struct("place", F.col("key").alias("line"), (F.col("n") > rare).alias("common"))))
    sequences = shared.groupBy("doc", "v", "n_lines").agg(each.alias("x")).select("doc", "v", "n_lines", *(F.col(f"x.{c}").alias(c) for c in ("place", "line", "common")))
    sequences = stash(sequences, "sequences")
    by_line = sequences.select("doc", "v", F.explode(F.array_distinct("line")).alias("key")).where("key & 1 = 1")  # no blank ones
    by_stretch = sequences.mapInArrow(_stretches, "doc long, v long, key long").distinct()
    pairs = stash(partners(by_line, rare).unionByName(partners(by_stretch, rare)).distinct(), "pairs")

    # partners of very many documents are given out several times, so that no task gets all their pairs
    asked = stash(pairs.groupBy("partner").agg(F.count("*").alias("n")), "partners")
    share = max(1_000, (asked.agg(F.sum("n")).first()[0] or 0) // 1_000)
    salts = F.ceil(F.col("n") / share).cast("int")
    busy = asked.where(F.col("n") > share).select("partner", salts.alias("salts"))  # at most 1,000
    later = pairs.join(F.broadcast(busy), "partner", "left").withColumn("salt", F.pmod(F.xxhash64("doc", "v"), F.coalesce("salts", F.lit(1))).cast("int"))
    later = later.select("partner", "salt", "doc", "v").join(sequences, ["doc", "v"])
    first = sequences.join(asked.withColumnRenamed("partner", "doc"), "doc").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    own = ["partner", "salt", "side", "doc", "v", "n_lines", "place", "line"]
    both = first.select(F.col("doc").alias("partner"), "salt", F.lit(0).alias("side"), *own[3:]).unionByName(later.withColumn("side", F.lit(1)).select(*own))
    gone = both.repartition("partner", "salt").sortWithinPartitions("partner", "salt", "side").mapInArrow(_aligned, "doc long, v long, gone array<int>")
    return gone.groupBy("doc", "v").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, keep_emptied: bool = True, rare: int = RARE) -> DataFrame:
    """The rows of ``docs`` without the lines they share with earlier documents; with ``counts`` also
    ``n_lines`` and ``n_deleted``; without ``keep_emptied`` no rows whose deletions left white space only.

    Earlier is a smaller id; a null id comes first. Lines end at newlines and are compared whole; remaining ones
    are joined by newlines. A document is aligned with its partners (above), and loses its blocks of aligned
    lines that are neighbours on both sides, but for blocks of blank lines only. A document that equals an earlier
    one loses all, unless it is blank. All columns are kept as they are but the text, which stays null where it
    is null, and columns ``n_lines`` and ``n_deleted``, which ``counts`` replaces; an empty text is one empty
    line. Rows that share an id are versions of one document, none earlier than the other; an empty table gives
    no rows.
    """
    key, mark = "__line_doc", "__line_version"
    if counts:
        docs = docs.drop("n_lines", "n_deleted")
    id_of, version = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.col(text_col))
    texts = docs.select(id_of.alias("doc"), F.col(text_col).alias("text"), version.alias("v"), F.xxhash64(F.lit(1), F.col(text_col)).alias("w")).where("text IS NOT NULL")
    texts = stash(texts.mapInArrow(_hashed, "doc long, v long, w long, lines array<long>"), "texts")
    vertices = texts.groupBy("v", "w").agg(F.min("doc").alias("first"), F.count("*").alias("n"), F.min_by("lines", "doc").alias("lines"))
    vertices = stash(vertices, "vertices")
    copies = join_groups(texts.select("doc", "v", "w"), vertices.where("n > 1").select("v", "w", "first", "n"), ["v", "w"]).where("doc > first")
    gone = deleted_places(vertices.select(F.col("first").alias("doc"), "v", "lines"), rare).select("doc", "v", "gone", F.lit(False).alias("copy"))
    marks = gone.unionByName(copies.select("doc", "v", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("copy")).distinct())
    schema = StructType(list(docs.schema.fields))
    if counts:
        schema = schema.add("n_lines", "long").add("n_deleted", "long")
    marks = marks.select(F.col("doc").alias(key), F.col("v").alias(mark), F.col("gone").alias(_GONE), F.col("copy").alias(_COPY))
    joined = docs.withColumns({key: id_of, mark: version}).join(marks, [key, mark], "left").drop(key, mark)
    return joined.mapInArrow(lambda b: _without(b, text_col, counts, keep_emptied), schema)


def _without(batches: Iterator[pa.RecordBatch], text_col: str, counts: bool, keep_emptied: bool) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, text_col, 8 << 20):
        texts: list[str | None] = []
        n_lines, n_gone = [], []
        for text, gone, copy in zip(*(b.column(c).to_pylist() for c in (text_col, _GONE, _COPY))):
            lines = text.split("\n") if text is not None else []
            n_lines.append(len(lines))
            lost = set(gone or [])
            if copy and text.strip(_BLANK):
                lost = set(range(len(lines)))
            if lost:
                text = "\n".join(x for i, x in enumerate(lines) if i not in lost)
            n_gone.append(len(lost))
            texts.append(text)
        at = b.schema.get_field_index(text_col)
        b = b.set_column(at, b.schema.field(at), pa.array(texts, pa.string())).drop_columns([_GONE, _COPY])
        if counts:
            b = b.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_deleted", pa.array(n_gone, pa.int64()))
        if not keep_emptied:
            b = b.filter(pa.array([not n or bool(t.strip()) for n, t in zip(n_gone, texts)], pa.bool_()))
        yield b
