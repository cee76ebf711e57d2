"""Exact top-k against all scores."""

import math
import random

from pyspark.sql import functions as F

from spokewise.llm import queries, topk
from tests.oracle import compare


def brute(rows, k=5, factor=256):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(factor * x) for x in v]

    clean = {(i, tuple(w)) for i, v in rows if i is not None and (w := whole(v)) is not None}
    out = set()
    for q, a in clean:
        if q % 50 == 0:
            best = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(b) == len(a)})[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()}


def test_all_scores(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.75, -1.0, 3.0]) for _ in range(40)]) for i in range(300)]
    rows += [(1000, None), (1001, [None] * 40), (1050, [math.nan] * 40), (1100, []), (1150, [1.0] * 3), (1151, [2.0] * 3), (None, [1.0] * 40)]
    rows += [rows[3], (2000, rows[7][1]), (2001, rows[7][1])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, query_block=2) == brute(rows)


def test_few_rows_and_ties(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [0.0, -1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == set() and found(spark, [(3, [1.0])]) == set()


def test_query(spark, sf):
    assert compare(spark, queries.op9_exact_topk, queries.OP9_SQL, sf)


def test_many_query_blocks(monkeypatch):
    """A task keeps the bests of few blocks of queries, and none is lost when it lets go of one."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    v = r.integers(-9, 9, (60, 4)).astype(float)

    def block(ids):
        rows = pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "v": pa.array([v[i].tolist() for i in ids])})
        return next(topk.packed(iter([rows]), 1, 100)).to_pylist()[0]

    queries = [block(range(a, a + 5)) for a in range(0, 60, 5)]
    pairs = [{**block(range(c, c + 20)), **{f"q_{k}": x for k, x in q.items() if k != "d"}} for c in (0, 20, 40) for q in queries]
    most = 0
    made = topk.Best

    class Counted(made):
        alive = 0

        def __init__(self, *args):
            nonlocal most
            super().__init__(*args)
            Counted.alive += 1
            most = max(most, Counted.alive)

        def __del__(self):
            Counted.alive -= 1

    monkeypatch.setattr(topk, "Best", Counted)
    found = {}
    for b in topk.met(iter([pa.RecordBatch.from_pylist([p]) for p in pairs]), 3):
        for row in b.to_pylist():
            found.setdefault(row["query_id"], set()).add((-row["score"], row["vec_id"]))
    assert most <= topk.HELD_BLOCKS + 1
    for q in range(60):
        want = sorted((-int(v[q] @ v[i]), i) for i in range(60) if i != q)[:3]
        assert sorted(found[q])[:3] == want
