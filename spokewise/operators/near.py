"""Short trips, each searched whole in one task, with its alternatives.

A region is a block (:mod:`.blocks`) and all that lies within some metres of its nodes, so most trips that begin in
the block never leave its region. A request goes to the region of its start, and all its searches are made there, one
after another. A search tells the least that a label cost, with the straight way left, that left the region: if the
goal is cheaper, no way outside can better it, as no metre costs less than one, and the result is that of a search of
the whole graph. With a budget, labels don't count that leave with too much spent to come back to the goal; without this
one request that no way serves was searched through the whole graph. Requests for which this doesn't hold in each of their searches are handed back, for
:mod:`.paths` to search from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import params as P
from ..storage import apart, stash
from .blocks import ASKS, Blocks, Limits, Moves, search

#: Straight ways, at the average cost of a metre, that a region reaches beyond its block; of the longest of so many of
#: 100 trips. A region of more nodes than so many blocks is left out.
REACH, SHARE, MOST = 2.0, 95, 6
METRES_A_DEGREE = 111_195.0
ROUTE = "query_id long, choice int, status string, edges array<long>, cost double, length_m double, budget_used_m double, expansions long"


def regions(b: Blocks, wanted: DataFrame, metres: float, size: int) -> DataFrame:
    """``block, moves`` of each ``wanted`` block: the moves out of all edges that end within ``metres`` of it, or a
    little more."""
    spark = wanted.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * wanted.count())  # few regions in a task
    nodes = b.edges.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("to_node").alias("node"), "block", "lat", "lon").distinct()
    narrow = nodes.agg(F.min(F.abs(F.cos(F.radians("lat"))))).first()[0] or 0.0
    high, wide = metres / METRES_A_DEGREE, metres / METRES_A_DEGREE / max(0.01, narrow)
    nodes = nodes.select("node", "block", F.floor(F.col("lat") / high).alias("y"), F.floor(F.col("lon") / wide).alias("x"))
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    cells = nodes.join(F.broadcast(wanted.select("block")), "block").select("block", "x", "y").distinct().withColumn("i", step).withColumn("j", step).select("block", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).distinct()
    held = nodes.groupBy("x", "y").agg(F.count("*").alias("n"))
    fit = apart(cells).join(held, ["x", "y"]).groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") <= MOST * size)
    inside = apart(cells.join(F.broadcast(fit.select("block")), "block")).join(nodes.select("node", "x", "y"), ["x", "y"]).select("block", "node")
    into = apart(inside).join(b.edges.select(F.col("to_node").alias("node"), F.col("edge_id").alias("in_edge")), "node").select(F.col("block").alias("region"), "in_edge")
    move = F.struct("in_edge", "edge_id", "to_node", "cost", "turn_cost", "spent", "length_m", "block", "lat", "lon")
    dealt = apart(into).join(b.pairs.drop("home"), "in_edge").repartition(parts, "region")
    return dealt.groupBy(F.col("region").alias("at")).agg(F.collect_list(move).alias("moves")).withColumnRenamed("at", "block")


def settled(go: DataFrame, b: Blocks, n: int, most_labels: int, size: int) -> DataFrame:
    """The routes of requests that one task could settle: rows of :data:`ROUTE`, of each request all that it gets.

    ``go``: ``query_id, from_node, goal, goal_lat, goal_lon, straight, wants``; only those that want it get up to
    ``n`` alternatives.
    """
    spark = go.sparkSession
    limits = replace(b.limits, alone=True)
    starts = go.select("query_id", "from_node").join(apart(b.edges), "from_node")
    letter = F.struct(F.lit(-1).alias("src"), F.col("edge_id").alias("edge"), "to_node", "cost", F.col("spent").alias("used"), F.col("length_m").alias("length"))
    starts = starts.groupBy("query_id").agg(F.min("block").alias("block"), F.collect_list(letter).alias("letters"))
    asks = go.join(apart(starts), "query_id")
    if b.budget_m is not None:  # the edges that end at the goal
        ends = go.select("query_id", F.col("goal").alias("to_node")).join(apart(b.edges.select("to_node", "edge_id")), "to_node")
        asks = asks.join(apart(ends.groupBy("query_id").agg(F.collect_list("edge_id").alias("ends"))), "query_id", "left")
    asks = stash(asks, "near")
    far = asks.agg(F.percentile_approx("straight", SHARE / 100)).first()[0]
    if far is None:
        return spark.createDataFrame([], ROUTE)
    a_row = max(ASKS, -(-asks.count() // (2 * spark.sparkContext.defaultParallelism)))
    chunks = stash(asks.groupBy("block").agg(F.ceil(F.count("*") / a_row).alias("chunks")), "chunks")
    table = stash(regions(b, chunks, far * b.cost_a_metre * REACH, size), "regions")
    dealt = asks.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).drop("chunks")
    dealt = stash(dealt.groupBy("block", "chunk").agg(F.collect_list(F.struct(*(c for c in asks.columns if c != "block"))).alias("asks")), "dealt")
    tasks = 4 * dealt.count()  # stated, as rows are few bytes and much work
    keys = ["block", "chunk"]
    copies = table.join(F.broadcast(dealt.select(*keys)), "block")
    rows = dealt.repartition(tasks, *keys).join(apart(copies.repartition(tasks, *keys)), keys)
    return stash(rows.select("block", "moves", "asks").mapInArrow(runner(limits, n, most_labels), ROUTE), "settled")


# --- inside a task ------------------------------------------------------------------------------------

def runner(limits: Limits, n: int, most_labels: int):
    schema = to_arrow_schema(StructType.fromDDL(ROUTE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                moves = Moves(b.column("moves")[k].values)
                moves.enclose(b.column("block")[k].as_py())
                for at in range(0, len(asks := b.column("asks")[k].values), ASKS):
                    rows = [row for ask in asks[at : at + ASKS].to_pylist() for row in routes(moves, ask, limits, n if ask["wants"] else 0, most_labels) or ()]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def routes(moves: Moves, ask: dict, limits: Limits, n: int, most_labels: int) -> list[dict] | None:
    """All routes of a request; none where a way outside the region might do better."""
    start = {x["edge"]: x for x in ask["letters"]}

    def best(dear: set[int]) -> tuple | None:
        """A path, its label and how many labels were met; no path where there is none. None: not settled."""
        price = lambda x: x["cost"] * (P.ALTERNATIVE_PENALTY if x["edge"] in dear else 1.0)
        letters = [x | {"cost": price(x)} for x in start.values() if limits.budget_m is None or x["used"] <= limits.budget_m]
        own = ask | {"letters": letters, "factors": [{"edge": e, "factor": P.ALTERNATIVE_PENALTY} for e in dear], "bound": None, "horizon": None, "marks": None}
        find = lambda x: search(moves.block, moves, x, limits, {}, np.zeros((0, 0)))
        open_ = lambda x: x.n > most_labels or (x.gone is not None and (x.goal is None or x.gone <= x.goal["cost"]))
        got = find(own)
        if open_(got) and limits.budget_m is not None:
            if "need" not in ask:
                ask["need"] = moves.spent_back(ask["ends"] or [])
            again = find(own | {"need": ask["need"]})
            if limits.exact or again.goal is None:  # a way that comes back may close a bucket to others
                got = again
        if open_(got):
            return None
        return ([got.goal["p_edge"], *got.goal["seg"]] if got.goal else None), got.goal, got.n

    def steps(path: list[int]) -> list[tuple[int, int, float, float]]:
        """Each edge, the one back from its end to its start, its cost with the turn into it, and its length."""
        x, node, out = start[path[0]], ask["from_node"], []
        to, cost, length = x["to_node"], x["cost"], x["length"]
        for edge, after in zip(path, [*path[1:], None]):
            out.append((edge, [m[0] for m in moves.get(edge) if m[1] == node], cost, length))
            if after is not None:
                node = to
                to, cost, length = next((m[1], m[2] + m[3], m[5]) for m in moves.get(edge) if m[0] == after)
        return out

    def row(choice: int, path: list[int] | None, cost: float | None, label: dict | None, met: int) -> dict:
        label = label or {}
        return {"query_id": ask["query_id"], "choice": choice, "status": "ok" if path else "unroutable", "edges": path, "cost": cost, "length_m": label.get("length"), "budget_used_m": label.get("used"), "expansions": met}

    first = best(set())
    if first is None:
        return None
    path, label, met = first
    out = [row(0, path, label and label["cost"], label, met)]
    if not path or n <= 0:
        return out
    kept = [set(path)]
    edges = lambda own: {e for edge, back, _, _ in own for e in (edge, *back)}
    dear, most = edges(steps(path)), label["cost"] * P.MAX_COST_RATIO
    for _ in range(P.MAX_ATTEMPTS):
        got = best(dear)
        if got is None:
            return None
        path, label, met = got
        if not path:
            break
        own = steps(path)
        real = sum(x[2] for x in own)
        if real > most:
            break
        shared = max(sum(x[3] for x in own if x[0] in other) for other in kept)
        new, more = label["length"] > 0 and shared / label["length"] <= P.MAX_OVERLAP, edges(own) - dear
        if new:
            kept.append(set(path))
            out.append(row(len(kept) - 1, path, real, label, met))
        if len(kept) > n or not (new or more):  # a path that is neither new nor adds an edge would be found again
            break
        dear |= more
    return out
