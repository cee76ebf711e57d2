"""Connected components of an undirected graph, by contraction.

Each task first joins the edges it reads to stars, so what is shuffled is at most a row for each of its nodes. In
a round, every node then goes over to the first of its neighbours and itself, in an order drawn anew for the round,
and the edges between what is left are those of the next round. A round takes a fixed share of the nodes away, so
all rounds together cost about as much as the first one. What remains below a bound is joined in one task; then the
rounds are read back, from the last to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import apart, drop, stash

#: Edges that a task joins at a time, and edges of a whole graph that one task joins.
HELD, LAST = 500_000, 200_000
#: A node with over one in so many of all edge ends is met by broadcast: fewer than as many nodes.
HOT = 1_000


def first_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges, and the smallest node that it is joined with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def ranked(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of each node in their order, and where the node of each place stands; nodes are numbers, texts, or
    structs of these, which are ordered field by field, as numpy sorts records many times slower than numbers."""
    fields = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    rank = np.zeros(len(nodes), dtype=np.int64)
    for x in fields:  # both factors are at most the number of nodes
        values, at = np.unique(x.to_numpy(zero_copy_only=False), return_inverse=True)
        _, where, rank = np.unique(rank * max(1, len(values)) + at, return_index=True, return_inverse=True)
    return rank, where


def loose(nodes: pa.Array) -> pa.Array:
    """Nodes whose fields may be null, as both ends of edges need one type."""
    return nodes.cast(pa.struct([pa.field(f.name, f.type) for f in nodes.type])) if pa.types.is_struct(nodes.type) else nodes


def _stars(batches: Iterator[pa.RecordBatch], most: int, loops: bool) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest one that it is joined with, for ``most`` edges at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        ends = pa.concat_arrays([loose(b.column(c)) for c in ("u", "v") for b in held])
        rank, where = ranked(ends)
        node, first = first_of(*np.split(rank, 2))
        keep = slice(None) if loops else node != first
        return pa.RecordBatch.from_arrays([ends.take(pa.array(where[x[keep]])) for x in (node, first)], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield joined()
            held = []
    if held:
        yield joined()


def met(rows: DataFrame, by: str, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a ``key``; ``n``: its rows) where ``by`` is the key, if any.

    Keys with a large share of all rows are met by broadcast, so theirs stay where they are."""
    least = max(1, total // HOT)
    own = [c for c in groups.columns if c not in (key, "n")]
    hot = groups.where(F.col("n") > least).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in own))
    cold = groups.where(F.col("n") <= least).select(F.col(key).alias("_key"), *own)
    there = rows.join(F.broadcast(hot), F.col(by) == F.col("_hot"), "left")
    # a row met already has no key any more, and so goes anywhere
    there = there.withColumn("_by", F.when(F.col("_hot").isNull(), F.col(by)))
    out = there.join(apart(cold), F.col("_by") == F.col("_key"), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in own))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, last: int = LAST) -> DataFrame:
    """``node, component`` for every end of an edge; the component is named by its smallest node.

    Loops and repeated edges do no harm; null ends are skipped; no edges give no rows. Every round is written to the
    shared folder. At most ``last`` edges are joined in one task, however large the graph was.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    kind = ends.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    stars = lambda df, most, loops: df.mapInArrow(lambda batches: _stars(batches, most, loops), schema)
    # loops stay in the first stars, so that every node is known
    known = stash(stars(ends.select("u", F.col("v").cast(kind)), HELD, True).distinct(), "stars")
    pairs, rounds = known.where("u <> v"), []
    for r in range(max_rounds):
        total = pairs.count()
        if total <= last:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("to"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(drawn(F.col("v"))).alias("m"), F.count("*").alias("n"))
        goes = stash(best.select("u", F.least("m", drawn(F.col("u")))["to"].alias("to"), "n"), "goes")
        rounds.append(goes)
        moved = met(pairs, "u", goes, "u", total).withColumnRenamed("to", "from").drop("u")
        moved = met(moved, "v", goes, "u", total).where("from <> to")
        new = stash(moved.select(F.greatest("from", "to").alias("u"), F.least("from", "to").alias("v")).distinct(), "pairs")
        if r:
            drop(pairs)
        pairs = new
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    # the bound on these rows makes one task of them
    found = stash(stars(pairs.coalesce(1), last + 1, True).select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    for goes in reversed(rounds):
        sizes = found.join(apart(goes.groupBy("to").agg(F.count("*").alias("n"))), F.col("to") == F.col("node"), "right").select(F.col("to").alias("node"), F.coalesce("root", "to").alias("root"), "n")
        found = stash(met(goes.select(F.col("u").alias("node"), "to"), "to", sizes, "node", goes.count()).select("node", "root"), "roots")
    nodes = known.select("u").distinct()
    if not rounds:
        return nodes.join(apart(found), nodes.u == found.node, "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("component"))
    all_of = nodes.join(apart(found), nodes.u == found.node, "left").select("u", F.coalesce("root", "u").alias("root"))
    least = stash(all_of.groupBy("root").agg(F.min("u").alias("component"), F.count("*").alias("n")), "least")
    return met(all_of, "root", least, "root", all_of.count()).select(F.col("u").alias("node"), "component")
