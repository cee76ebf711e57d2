"""Exact top-k by inner product, branch and bound over blocks of dimensions.

Candidates lie in vertical layout, one row for each dimension. For each query, products are added up block
of dimensions by block; before each block the candidates whose sum so far, plus the most that the mass of
the dimensions left allows (Cauchy-Schwarz), stays below the k-th best exact score known are dropped and
the survivors compacted. Candidates that could still tie are kept, so ties go to the smaller id exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash

#: Queries and candidates in one block, and dimensions that are added at once.
QUERY_BLOCK, CANDIDATES, DIMENSIONS = 8_192, 8_192, 16
#: Blocks of queries whose bests a task keeps at a time.
HELD_BLOCKS = 4

#: Sums stay exact in doubles up to here; larger inputs are summed as Python integers.
EXACT = float(2**53)
LONG = 2**63 - 1


def scaled(vectors: pa.Array, factor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their components as whole numbers (in doubles)."""
    rows = vectors.to_pylist()
    keep, out = [], []
    for v in rows:
        ok = v is not None and None not in v
        if ok:
            a = np.asarray(v, dtype=np.float64)
            ok = bool(np.isfinite(a).all())
        if ok:
            with np.errstate(over="ignore"):
                out.append(np.floor(factor * a))
            ok = bool(np.isfinite(out[-1]).all())
            if not ok:
                out.pop()
        keep.append(ok)
    return np.array(keep, dtype=bool), out


class Best:
    """The best ``k`` of each query so far; more at a tie."""

    def __init__(self, n: int, k: int):
        self.k, self.top = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, q: int, scores: list[int], ids: list[int]) -> None:
        best = sorted({*self.top[q], *((-s, i) for s, i in zip(scores, ids))})[: self.k]
        self.top[q] = best
        if len(best) == self.k:
            self.least[q] = -best[-1][0]


def scan(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
    """Meets candidates (``columns``: dimension by candidate) with every query."""
    dims = len(columns)
    cuts = [*range(0, dims, DIMENSIONS), dims] if dims else [0, 0]
    most = np.abs(queries).max(initial=0) * np.abs(columns).max(initial=0) * max(1, dims)
    if most >= EXACT:
        whole = [[int(x) for x in c] for c in columns.T]
        for q, v in enumerate(queries):
            own = [int(x) for x in v]
            got = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(own, c)))), i) for c, i in zip(whole, ids.tolist()) if i != query_ids[q]]
            best.add(q, [s for s, _ in got], [i for _, i in got])
        return
    squares = np.array([(columns[c:] ** 2).sum(0) for c in cuts[:-1]] + [np.zeros(columns.shape[1])])
    rest = np.sqrt(squares)  # of each candidate, from each cut on
    mass = np.sqrt(np.array([(queries[:, c:] ** 2).sum(1) for c in cuts[:-1]] + [np.zeros(len(queries))]))
    everyone = np.arange(len(ids))
    for q in range(len(queries)):
        alive, total = everyone, np.zeros(len(ids))
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if np.isfinite(best.least[q]):
                stays = total + rest[j, alive] * mass[j, q] * (1 + 1e-9) + 1e-6 >= best.least[q]
                if not stays.all():
                    alive, total = alive[stays], total[stays]
                if not len(alive):
                    break
            part = columns[a:b] if len(alive) == len(ids) else columns[a:b, alive]
            total = total + queries[q, a:b] @ part
        else:
            other = ids[alive] != query_ids[q]
            alive, total = alive[other], total[other]
            if len(alive) > best.k:
                least = np.partition(total, -best.k)[-best.k]
                alive, total = alive[total >= least], total[total >= least]
            if len(alive) > 4 * best.k:  # ties in plenty: the smaller ids
                order = np.lexsort((ids[alive], -total))[: best.k]
                alive, total = alive[order], total[order]
            best.add(q, total.astype(np.int64).tolist(), ids[alive].tolist())


BLOCK = "d int, n int, wide boolean, ids binary, vectors binary"


def packed(batches: Iterator[pa.RecordBatch], factor: int, most: int) -> Iterator[pa.RecordBatch]:
    """Scaled vectors in blocks of one length and ``most`` rows, vertical: dimension by dimension."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def block(d: int) -> pa.RecordBatch:
        ids, vs = held.pop(d)
        columns = np.ascontiguousarray(np.array(vs).reshape(len(ids), d).T)
        wide = bool(np.abs(columns).max(initial=0) >= 2**31 - 1)
        data = columns.astype(np.float64 if wide else np.int32).tobytes()
        return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "wide": [wide], "ids": [np.array(ids, dtype=np.int64).tobytes()], "vectors": [data]})

    for b in batches:
        keep, vs = scaled(b.column("v"), factor)
        for i, v in zip((i for i, ok in zip(b.column("id").to_pylist(), keep) if ok), vs):
            ids, own = held.setdefault(len(v), ([], []))
            ids.append(i)
            own.append(v)
            if len(ids) == most:
                yield block(len(v))
    for d in list(held):
        yield block(d)


def opened(d: int, n: int, wide: bool, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64 if wide else np.int32).reshape(d, n).astype(np.float64)


def met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each query of every pair of blocks; a task keeps those of a few blocks of queries at a time."""
    best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, Best]] = {}

    def out(ids: np.ndarray, _, own: Best) -> Iterator[pa.RecordBatch]:
        rows = [(int(q), i, -s) for q, top in zip(ids, own.top) for s, i in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    for b in batches:
        for i in range(b.num_rows):
            own = {c: b.column(c)[i].as_py() for c in b.schema.names}
            key = (own["d"], own["q_ids"])
            if key not in best:
                if len(best) == HELD_BLOCKS:
                    yield from out(*best.pop(next(iter(best))))
                ids, columns = opened(own["d"], own["q_n"], own["q_wide"], own["q_ids"], own["q_vectors"])
                best[key] = ids, np.ascontiguousarray(columns.T), Best(len(ids), k)
            scan(best[key][2], *best[key][:2], *opened(own["d"], own["n"], own["wide"], own["ids"], own["vectors"]))
    for held in best.values():
        yield from out(*held)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, query_block: int = QUERY_BLOCK, candidates: int = CANDIDATES) -> DataFrame:
    """Each query's ``k`` best rows: ``query_id, rank, vec_id, score``.

    ``is_query`` picks the queries; candidates are all rows of another id. Score: the inner product of
    ``floor(factor * x)``, exact; beyond 64 bits it stands at the range's end. Ties go to the smaller id.
    Rows with a null id, a null vector, a null or non-finite component (also once scaled) take no part;
    vectors of different lengths don't meet; a repeated row is one candidate; fewer candidates than ``k``
    are all returned; no queries give no rows; other columns are not read.

    Both sides are packed into blocks of bounded size, written once to the shared folder, and every block of
    queries meets every block of candidates; no vector passes the driver. A task keeps ``HELD_BLOCKS`` blocks of
    queries, and returns the ``k`` best of each query when it lets go of its block.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL")
    asked = rows.where("q").select("id", "v").dropDuplicates()
    parts = max(1, -(-asked.count() // query_block))
    queries = stash(asked.repartition(parts, "id").mapInArrow(lambda b: packed(b, factor, query_block), BLOCK), "queries")
    blocks = stash(rows.select("id", "v").mapInArrow(lambda b: packed(b, factor, candidates), BLOCK), "candidates")
    # lengths are compared as a range, for an equality would send all blocks of one length to one task
    pairs = blocks.crossJoin(queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))).where("d <= q_d AND d >= q_d").drop("q_d")
    found = pairs.mapInArrow(lambda b: met(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
