"""Near-duplicate groups by a chosen-path set similarity join on word shingles.

Equal sets are one vertex from the start. In each of several independent trees a document goes from a node to
two of its children, those of its smallest shingles under two hashes that the node chooses. A node of few documents
is not branched any further: all its documents are compared, by 128-value sketches, from each one to those not
reached yet, and the likely families stay together. Each document's whole set then goes once to its family, where
links are confirmed on whole sets.

Two documents of similarity s take one child of a node together with chance s for each of the two. At s >= 0.8 that
is a branching process which dies out with a chance of 1/16 at most, however deep the tree is; so all six trees
part a pair with a chance of 6 in 100 million, whatever the size of the nodes (the hashes come from a pool of
128, which makes them nearly independent). A sketch misses a pair by six standard deviations, 3 in 100 million. So the
whole search loses a pair at the threshold with a chance below one in ten million, and one of higher similarity
far less often.

Links are confirmed on the names of all shingles of both sets, polynomials modulo a prime above 2**60: of a million
pairs of shingles of two documents, any two are mistaken with a chance below 1e-12 (``windows.Sums``).

A node whose documents mostly go to the same child under both hashes is a family, which branching would not part.
It is compared whole, as are large nodes of the last depth: cut into parts, each part compared; then the parts with
one another, but for documents already known to belong together. No pair of a node is left out, so the cost of
such a node grows with the square of the number of its documents outside its largest family.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import stash
from .common import NULL_ID, ids_of, join_groups, mix, pack_texts, text_slices, unpacked
from .windows import Sums, flat_bytes, groups, ragged, words

WIDTH, PERCENT = 5, 80
TREES, DEPTH, SKETCH = 6, 4, 128
#: Documents of a node that is branched no further; share of a node that takes one child, in a family.
NODE, DENSE = 500, 0.5
#: Documents of a node, and shingles of a family, that one task compares; beyond, nodes are compared part by part
#: and a family node by node.
PART, FAMILY = 1_000, 2_000_000

#: Bytes of whole sets, about, that a task holds for several families at once.
SETS_BYTES = 64 << 20
#: Standard deviations that a sketch may fall short by.
SHORT = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAWN = np.random.default_rng(41).integers(0, 2**64, (2, SKETCH), dtype=np.uint64)
_DRAWN[1] |= np.uint64(1)


def shingles(flat: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, as 64-bit names in order, and where each row's start."""
    start, end, before = words(flat, off)
    name = Sums(_LOWER[flat]).of(start, end)
    sums = Sums(name)
    size = np.diff(before)
    n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    at = ragged(before[:-1], n)
    row = np.repeat(np.arange(len(size)), n)
    value = sums.of(at, np.minimum(at + width, before[1:][row]))
    order = np.lexsort((value, row))
    value = value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(size) + 1), "left")


def signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``doc, n, s1, s2, sketch, minima`` of each row: two names of the whole set, and its smallest shingle under
    each hash of the pool, in 8 and in 32 bits."""
    for b in text_slices(batches, "text", 1 << 20):
        value, off = shingles(*flat_bytes(b.column("text")), width)
        n = np.diff(off)
        some = np.flatnonzero(n)
        sketch = np.zeros((len(n), SKETCH), dtype=np.uint8)
        minima = np.zeros((len(n), SKETCH), dtype=np.uint32)
        s = np.zeros((2, len(n)), dtype=np.uint64)
        if len(some):
            at = off[:-1][some]
            for k in range(2):
                s[k, some] = np.add.reduceat(mix(value + np.uint64(k + 1)), at)
            for k in range(SKETCH):
                low = mix(np.minimum.reduceat((value ^ _DRAWN[0, k]) * _DRAWN[1, k], at))
                sketch[some, k] = (low & np.uint64(255)).astype(np.uint8)
                minima[some, k] = (low >> np.uint64(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc"),
                pa.array(n.astype(np.int64)),
                *(pa.array(x.view(np.int64)) for x in s),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(n) + 1, SKETCH, dtype=np.int32)), pa.array(minima.view(np.int32).ravel())),
            ],
            ["doc", "n", "s1", "s2", "sketch", "minima"],
        )


def reached(n: int, near) -> np.ndarray:
    """The first member of each one's group; ``near(i, others)`` says which others are linked with ``i``."""
    root = np.full(n, -1)
    left = np.arange(n)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        left = left[left != first]
        queue = [first]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            root[found] = first
            queue += found.tolist()
            left = left[~hit]
    return root


def stars(group: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The pairs of different groups that are in one star, once each."""
    both = np.stack([group, group[root]])
    return np.unique(both[:, both[0] != both[1]], axis=1)


def likely_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stars ``a, b`` of documents of one node whose sketches are alike; those of one ``known`` group are linked."""
    share = percent / 100
    least = SKETCH * max(0.0, share - SHORT * (share * (1 - share) / SKETCH) ** 0.5)
    for t in groups(batches, "path", 20_000):
        t = t.combine_chunks()
        path, doc, size, known = (t.column(c).to_numpy() for c in ("path", "doc", "n", "known"))
        sketch = flat_bytes(t.column("sketch"))[0].reshape(len(doc), SKETCH)
        cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        out: list[np.ndarray] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            order = a + np.argsort(doc[a:b], kind="stable")
            own, sizes, group = sketch[order], size[order], known[order]

            def near(i: int, others: np.ndarray, own=own, sizes=sizes, group=group) -> np.ndarray:
                hit = group[others] == group[i]
                fits = ~hit & (np.minimum(sizes[i], sizes[others]) * 100 >= percent * np.maximum(sizes[i], sizes[others]))
                hit[fits] = (own[others[fits]] == own[i]).sum(1) >= least
                return hit

            out.append(stars(group, reached(b - a, near)))
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


class Alike:
    """Which sets of a family are linked, by an index of their shingles."""

    def __init__(self, values: np.ndarray, off: np.ndarray, percent: int):
        _, self.token = np.unique(values, return_inverse=True)
        self.off, self.size, self.percent = off, np.diff(off), percent
        self.indexed = np.zeros(0, dtype=np.int64)

    def index(self, rows: np.ndarray) -> None:
        self.indexed = rows
        n = self.size[rows]
        token = self.token[ragged(self.off[:-1][rows], n)]
        order = np.argsort(token, kind="stable")
        self.rows = np.repeat(rows, n)[order]
        self.starts = np.searchsorted(token[order], np.arange(int(self.token.max(initial=-1)) + 2))

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        if not len(self.indexed) or 2 * len(others) < len(self.indexed):
            self.index(others)
        own = self.token[self.off[i] : self.off[i + 1]]
        lo = self.starts[own]
        both = np.bincount(self.rows[ragged(lo, self.starts[own + 1] - lo)], minlength=len(self.size))[others]
        return 100 * both >= self.percent * (self.size[i] + self.size[others] - both)


def links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stars ``a, b`` of documents of one family that links on whole sets join."""
    for t in groups(batches, "key", 2_000, SETS_BYTES):
        key, doc, known = (t.column(c).to_numpy() for c in ("key", "doc", "known"))
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        out: list[np.ndarray] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            order = np.argsort(doc[a:b], kind="stable")
            flat, off = flat_bytes(t.column("shingles").slice(a, b - a).combine_chunks().take(pa.array(order)))
            group = known[a:b][order]
            alike = Alike(flat.copy().view(np.uint64), off // 8, percent)
            out.append(stars(group, reached(b - a, lambda i, others, group=group, alike=alike: (group[others] == group[i]) | alike(i, others))))
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def sized(rows: DataFrame) -> DataFrame:
    """``key, n, who``: number and hash of the documents of each node of two or more."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("who")).where("n > 1")


def whole_nodes(rows: DataFrame) -> DataFrame:
    """``key, doc`` of nodes that are compared whole; those with the same documents are kept once."""
    sizes = stash(sized(rows), "sizes")
    once = sizes.groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    return stash(rows.join(once, "key", "left_semi").select("key", "doc"), "nodes")


def branches(reps: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """The two children of each tree's root, and those of any node: hashes of the node and one of the minima."""
    minima, half = F.col("minima"), SKETCH // 2 - TREES
    kid = lambda key, b, at: F.struct(F.lit(b).alias("b"), F.xxhash64(key, F.lit(b), F.get(minima, at)).alias("kid"))
    roots = F.array(*(kid(F.lit(t), b, F.lit(2 * t + b)) for t in range(TREES) for b in range(2)))
    return roots, lambda key: F.array(*(kid(key, b, (F.lit(2 * TREES + b * half) + F.pmod(F.xxhash64(key, F.lit(b)), F.lit(half))).cast("int")) for b in range(2)))


def nodes_of(reps: DataFrame, node: int, depth: int) -> DataFrame:
    """``key, doc`` of the nodes in which documents are compared; ``reps``: ``doc, minima``."""
    roots, kids_of = branches(reps)
    rows = reps.select("doc", F.explode(roots).alias("x")).select(F.col("x.kid").alias("key"), "doc")
    whole: list[DataFrame] = []
    for _ in range(depth):
        large = stash(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > node).select("key"), "large")
        if large.isEmpty():
            break
        whole.append(rows.join(large, "key", "left_anti"))
        kids = rows.join(large, "key", "left_semi").join(reps, "doc").select("key", "doc", F.explode(kids_of(F.col("key"))).alias("x"))
        kids = stash(kids.select("key", "doc", "x.b", "x.kid"), "kids")
        most = kids.groupBy("key", "b", "kid").agg(F.count("*").alias("c")).groupBy("key", "b").agg((F.max("c") / F.sum("c")).alias("share"))
        dense = stash(most.groupBy("key").agg(F.min("share").alias("share")).where(F.col("share") >= DENSE).select("key"), "dense")
        whole.append(kids.where("b = 0").join(dense, "key", "left_semi").select("key", "doc"))
        rows = kids.join(dense, "key", "left_anti").select(F.col("kid").alias("key"), "doc")
    whole.append(rows)
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return whole_nodes(out)


def part_of(parts: Column | str) -> Column:
    """The part of a document's key that it falls in, another one under each key."""
    return F.pmod(F.xxhash64("doc", "key"), parts).cast("int")


def in_parts(slots: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``key, doc, known`` with each key of more than ``most`` (the sum of ``n``) cut into parts; and those keys."""
    sizes = slots.groupBy("key").agg(F.ceil(F.sum("n") / most).alias("parts"))
    large = stash(sizes.where("parts > 1"), "large")
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part_of("parts")))
    return slots.join(large, "key", "left").select(key.alias("key"), "doc", F.col("doc").alias("known")), large


def across_parts(slots: DataFrame, large: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """``key, doc, known`` by which all documents of a large key meet that are in different components (``known``).

    Documents outside the key's largest component meet one another and those inside, part by part.
    """
    rows = slots.join(large.select("key"), "key").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left")
    rows = stash(rows.select("key", "doc", "n", F.coalesce("component", "doc").alias("known")), "large")
    sizes = rows.groupBy("key", "known").agg(F.sum("n").alias("total")).groupBy("key")
    sizes = sizes.agg(F.max_by("known", F.struct("total", "known")).alias("main"), F.max("total").alias("inside"), F.sum("total").alias("whole"), F.count("*").alias("groups")).where("groups > 1")
    sizes = sizes.select("key", "main", F.ceil(F.col("inside") / most).alias("inside"), F.ceil((F.col("whole") - F.col("inside")) / most).alias("outside"))
    each = lambda parts, key: F.transform(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int")), key)
    out, within = part_of("outside"), part_of("inside")
    keys = F.when(F.col("known") == F.col("main"), each("outside", lambda p: F.xxhash64("key", F.lit(2), p, within))).otherwise(
        F.concat(each("outside", lambda p: F.xxhash64("key", F.lit(1), F.least(out, p), F.greatest(out, p))), each("inside", lambda p: F.xxhash64("key", F.lit(2), out, p)))
    )
    return rows.join(sizes, "key").select(F.explode(keys).alias("key"), "doc", "known")


def linked(slots: DataFrame, most: int, compare: Callable[[DataFrame], DataFrame], also: DataFrame | None = None) -> DataFrame:
    """``node, component`` by the links that ``compare`` finds between documents that share a key of ``slots``,
    and those of ``also``."""
    cut, large = in_parts(slots, most)
    pairs = compare(cut)
    pairs = stash((pairs if also is None else pairs.unionByName(also)).distinct(), "links")
    found = connected_components(pairs)
    if large.isEmpty():
        return found
    more = compare(across_parts(slots, large, stash(found, "found"), most))
    return connected_components(pairs.unionByName(more.distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, node: int = NODE, part: int = PART, family: int = FAMILY, depth: int = DEPTH) -> DataFrame:
    """The group of each document: ``doc_id, n_shingles, component_id, kept``.

    Words lie between ASCII white space, A-Z as a-z; a document's set is its distinct shingles of ``width``
    words, or its whole sequence if it has fewer. Two documents are linked if 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the
    document's own. One row for each row; a null or wordless text has an empty set and is linked with
    nothing; rows that share an id are one document; a null id comes before all others; an empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"))
    marked = stash(rows.mapInArrow(lambda b: signed(b, width), "doc long, n long, s1 long, s2 long, sketch binary, minima array<int>"), "signed")
    names = ["s1", "s2", "n"]
    first = stash(marked.where("n > 0").groupBy(*names).agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "sets")
    reps = stash(join_groups(marked, first, names, "copies").where("doc = rep").select("doc", "s1", "n", "sketch", "minima").dropDuplicates(["doc", "s1"]), "reps")
    members = nodes_of(reps.select("doc", "minima"), node, depth)

    def by_sketch(slots: DataFrame) -> DataFrame:
        met = slots.withColumnRenamed("key", "path").join(reps.select("doc", "n", "sketch"), "doc")
        return met.repartition("path").sortWithinPartitions("path").mapInArrow(lambda b: likely_links(b, percent), "a long, b long")

    likely = linked(members.withColumn("n", F.lit(1)), part, by_sketch)
    families = stash(likely.select(F.col("node").alias("doc"), F.col("component").alias("key")), "families")
    weighed = families.join(reps.select("doc", "n"), "doc")
    large = weighed.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > family).select("key")
    slots = weighed.join(large, "key", "left_anti").select("key", "doc", F.lit(0).alias("n")).unionByName(
        weighed.join(large, "key", "left_semi").select("doc", "n").join(members, "doc").select("key", "doc", F.greatest("n", F.lit(family // part)).alias("n"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, z, keys, known in zip(ids_of(b).tolist(), b.column("z"), b.column("keys").to_pylist(), b.column("known").to_pylist()):
                flat = np.frombuffer(unpacked(z), np.uint8)
                value, _ = shingles(flat, np.array([0, len(flat)]), width)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([known] * n, pa.int64()), pa.array([value.tobytes()] * n, pa.binary())],
                    ["key", "doc", "known", "shingles"],
                )

    packed = rows.mapInArrow(pack_texts, "doc long, z binary")

    def by_sets(slots: DataFrame) -> DataFrame:
        wanted = packed.join(slots.groupBy("doc", "known").agg(F.collect_list("key").alias("keys")), "doc")
        met = wanted.mapInArrow(sets, "key long, doc long, known long, shingles binary").repartition("key").sortWithinPartitions("key")
        return met.mapInArrow(lambda b: links(b, percent), "a long, b long")

    slim = marked.select("doc", *names)
    several = stash(slim.where("n > 0").groupBy("doc").agg(F.min("s1").alias("a"), F.max("s1").alias("z")).where("a < z").select("doc"), "several")
    versions = None
    if not several.isEmpty():
        own = stash(slim.join(several, "doc").join(first, names).select("doc", "rep").distinct(), "versions")
        versions = own.join(own.groupBy("doc").agg(F.min("rep").alias("a")), "doc").select("a", F.col("rep").alias("b"))
    named = linked(slots, family, by_sets, versions).select(F.col("node").alias("rep"), "component")
    named = first.join(named, "rep", "left").select(*names, "copies", F.coalesce("component", "rep").alias("component"))
    out = join_groups(slim, named, names, "copies").select("doc", "n", "component").unionByName(slim.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    component = F.col("component")
    back = lambda c: F.when(c != NULL_ID, c)
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(component).alias("component_id"), (component == F.col("doc")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the one document that stays of each group."""
    found = near_duplicates(docs, id_col, text_col, width, percent).where("kept")
    kept = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__near_doc")).distinct()
    return docs.withColumn("__near_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).join(kept, "__near_doc", "left_semi").drop("__near_doc")
