"""A road graph cut into blocks of neighbouring nodes, and the search inside one of them.

An edge lives in the block of its end. A block's row holds the moves out of all edges that end in it, so a search
within needs nothing else; what leaves the block goes to others as letters. The table is bucketed by block and
written once for a rider, so a round of a search moves its letters to the blocks and never the graph.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import asin, cos, inf, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..storage import apart, stash, stash_bucketed
from .ways import numbered

#: Nodes of a block, requests that meet a block in one row, blocks that a worker keeps.
NODES, ASKS, KEPT = 12_000, 128, 2
#: Blocks of a bucket: Spark reads all rows of a bucket at once, as they are fewer than a batch.
IN_BUCKET = 2
#: A request with more labels than this that are kept is sent on at once, so a worker holds those of one.
SENT = 5_000
LETTER = "struct<edge: bigint, to_node: bigint, cost: double, used: double, length: double, p_edge: bigint, p_used: double, p_src: int, seg: array<bigint>>"
RUN = f"round int, query_id long, block int, bound double, waits double, n_labels long, goal {LETTER}, mail array<struct<dst: int, digest: bigint, letters: array<{LETTER}>>>, changed array<int>, labels array<{LETTER}>"


@dataclass(frozen=True)
class Blocks:
    """``edges``: those that may be ridden (``edge_id, from_node, to_node, length_m, cost, spent, block``, the block
    of their end); ``pairs``: those that follow each other (``in_edge, edge_id, turn_cost``, ...); ``table``: a row for
    each block. ``cost_a_metre``: of all edges, on average. ``n_marks``: entries of an edge's ``marks``
    (:mod:`.landmarks`), 0 for none."""

    edges: DataFrame
    pairs: DataFrame
    table: DataFrame
    cost_a_metre: float
    budget_m: float | None
    buckets: int | None
    n_marks: int = 0

    @property
    def limits(self) -> Limits:
        exact = self.budget_m is not None and not self.buckets
        return Limits(self.budget_m, self.buckets or 1, exact)


@dataclass(frozen=True)
class Limits:
    budget_m: float | None = None
    buckets: int = 1
    exact: bool = False
    most_cost: float = inf
    keep_labels: bool = False
    #: Whether labels and letters name the edges since the letter before; a path is laid out by them.
    keep_paths: bool = True
    #: Whether one run settles a request: it ends where the goal, or a label that left, is the next.
    alone: bool = False

    def bucket(self, used: float) -> int:
        return 0 if self.budget_m is None or self.buckets == 1 else min(self.buckets - 1, int(used / (self.budget_m / self.buckets)))


def z_order(lat: Column, lon: Column, south: float, west: float, span: float, bits: int = 24) -> Column:
    """A number that neighbouring places mostly share the first digits of: the bits of both in turn, within a square of
    ``span`` degrees. Places outside it count as at its edge."""
    whole = lambda c, low: F.least(F.greatest(F.floor((c - F.lit(low)) / F.lit(span) * 2**bits), F.lit(0)), F.lit(2**bits - 1)).cast("long")
    x, y = whole(lat, south), whole(lon, west)
    out = F.lit(0).cast("long")
    for k in range(bits):
        for c, to in ((x, 2 * k + 1), (y, 2 * k)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), to))
    return out


def homes(edges: DataFrame, nodes: DataFrame | None, size: int) -> DataFrame:
    """``node, block, lat, lon``: nodes in blocks of ``size``, neighbours together; by id where there are no places."""
    ends = edges.select(F.col("from_node").alias("node")).unionByName(edges.select(F.col("to_node").alias("node"))).distinct()
    number = lambda c: F.col(c).cast("double").alias(c)
    if nodes is None:
        ends = ends.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "z": F.col("node")})
    else:
        ends = ends.join(apart(nodes.select(F.col("node_id").alias("node"), number("lat"), number("lon"))), "node", "left")
        # the places' own square: of the whole map's, a table that goes beyond a pole would keep no order there
        south, north, west, east = (x or 0.0 for x in nodes.select(number("lat"), number("lon")).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first())
        z = z_order(F.col("lat"), F.col("lon"), south, west, max(north - south, east - west, 1e-9))
        ends = ends.withColumn("z", F.coalesce(z, F.lit(0).cast("long")))
    return stash(numbered(ends, "i", ["z", "node"]).select("node", F.floor(F.col("i") / size).cast("int").alias("block"), "lat", "lon"), "homes")


def blocks_of(costs: DataFrame, turns: DataFrame | None = None, nodes: DataFrame | None = None, budget_m: float | None = None, buckets: int | None = None, size: int = NODES, landmarks: DataFrame | None = None) -> Blocks:
    """The graph of one rider in blocks. Edges that are ``over`` spend the budget, if there is one; without
    ``buckets`` it is kept exactly. Places of ``nodes`` guide a search, and so do ``landmarks`` (``edge_id, marks``)."""
    number = lambda c: F.col(c).cast("double").alias(c)
    spent = F.when(F.col("over"), F.col("length_m").cast("double")).otherwise(0.0) if budget_m is not None else F.lit(0.0)
    e = costs.where("allowed").select(F.col("edge_id").cast("long").alias("edge_id"), F.col("from_node").cast("long").alias("from_node"), F.col("to_node").cast("long").alias("to_node"), number("length_m"), number("cost"), spent.alias("spent"))
    e = stash(e, "allowed")  # read five times below, and costs may be long in the making
    e = e.join(apart(homes(e, nodes, size).withColumnRenamed("node", "to_node")), "to_node")
    e = stash(e if landmarks is None else e.join(apart(landmarks.select("edge_id", "marks")), "edge_id", "left"), "ridable")
    pairs = e.select(F.col("edge_id").alias("in_edge"), F.col("to_node").alias("from_node"), F.col("block").alias("home")).join(apart(e.drop("marks")), "from_node")
    if turns is None:
        pairs = pairs.withColumn("turn_cost", F.lit(0.0))
    else:
        pairs = pairs.join(apart(turns.select("in_edge", F.col("out_edge").alias("edge_id"), number("turn_cost"))), ["in_edge", "edge_id"], "left").fillna(0.0, ["turn_cost"])
    pairs = stash(pairs.drop("from_node"), "moves")
    move = F.struct("in_edge", "edge_id", "to_node", "cost", "turn_cost", "spent", "length_m", "block", "lat", "lon")
    mean, last = e.agg(F.sum("cost") / F.nullif(F.sum("length_m"), F.lit(0.0)), F.max("block")).first()
    parts = max(int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-((last or 0) + 1) // IN_BUCKET))
    dealt = pairs.withColumnRenamed("home", "at").repartition(parts, "at")
    rows, n_marks = dealt.groupBy(F.col("at").alias("block")).agg(F.collect_list(move).alias("moves")), 0
    if landmarks is None:
        rows = rows.withColumn("marks", F.lit(None).cast("array<struct<edge_id: bigint, marks: array<double>>>"))
    else:  # of edges that end in the block or leave it
        n_marks = e.agg(F.max(F.size("marks"))).first()[0] or 0
        near = e.select("block", "edge_id").unionByName(pairs.select(F.col("home").alias("block"), "edge_id")).distinct()
        near = near.join(e.where("marks IS NOT NULL").select("edge_id", "marks"), "edge_id")
        rows = rows.join(near.groupBy("block").agg(F.collect_list(F.struct("edge_id", "marks")).alias("marks")), "block", "left")
    buckets = min(max(1, buckets), P.BUDGET_BUCKETS_MOST) if buckets else None
    return Blocks(e, pairs, stash_bucketed(rows, "blocks", "block", parts), max(1.0, mean or 1.0), budget_m, buckets, max(n_marks, 0))


# --- inside a task ------------------------------------------------------------------------------------

def least(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted ``keys`` and the least of its rows, column by column."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.minimum.reduceat(rows, first, axis=0)


def swept(table: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least costs of each place (row) for each column, from those that ``table`` begins with, by moves from ``a`` to
    ``b``, sorted by ``b``. Only moves out of places that changed are taken anew."""
    changed = np.isfinite(table).any(axis=1)
    while changed.any():
        at = np.flatnonzero(changed[a])
        changed = np.zeros(len(table), dtype=bool)
        if len(at):
            to, best = least(table[a[at]] + cost[at, None], b[at])
            better = (best < table[to]).any(axis=1)
            to = to[better]
            table[to] = np.minimum(table[to], best[better])
            changed[to] = True
    return table


class Moves:
    """The moves out of each edge of a block: its columns, sorted by the edge that one comes by. Rows are made of them
    for edges that a search takes only, so short trips don't cost a whole block."""

    def __init__(self, moves: pa.StructArray):
        self.into = moves.field("in_edge").to_numpy(zero_copy_only=False)
        order = np.argsort(self.into, kind="stable")
        self.into = self.into[order]
        self.columns = [_values(moves.field(c))[order] for c in ("edge_id", "to_node", "cost", "turn_cost", "spent", "length_m", "block", "lat", "lon")]
        self.made: dict[int, list[tuple]] = {}
        self.block: int | None = None

    def enclose(self, block: int) -> None:
        """Makes one block of all edges that have moves here, and lets others lie outside."""
        self.block, own = block, np.unique(self.into)
        at = np.minimum(np.searchsorted(own, self.columns[0]), max(0, len(own) - 1))
        self.columns[6] = np.where(own[at] == self.columns[0], block, -1)

    def spent_back(self, ends: list[int]) -> float:
        """At least what a way from outside spends, from its first edge here on, to one of the edges ``ends`` (all those
        into a node); infinite where there is none.

        A way comes in by an edge that no move here leads to, as moves out of all edges that end at a node are here or
        none is."""
        own = np.unique(self.into)
        if not np.isin(ends, own).all():
            return 0.0
        within, table = self.columns[6] == self.block, np.full((len(own), 1), inf)
        table[np.searchsorted(own, ends)] = 0.0
        to = np.searchsorted(own, self.columns[0][within])
        swept(table, to, np.searchsorted(own, self.into[within]), self.columns[4][within].astype(float))
        return float(np.delete(table, to).min(initial=inf))

    def get(self, edge: int, none: tuple = ()) -> list[tuple]:
        found = self.made.get(edge)
        if found is None:
            a, b = np.searchsorted(self.into, edge, "left"), np.searchsorted(self.into, edge, "right")
            found = self.made[edge] = list(zip(*(c[a:b].tolist() for c in self.columns)))
        return found or none


def _values(column: pa.Array) -> np.ndarray:
    """A column as an array, nulls as None."""
    return np.array(column.to_pylist(), dtype=object) if column.null_count else column.to_numpy(zero_copy_only=False)


_kept: OrderedDict[tuple[str, int], tuple[Moves, dict, np.ndarray]] = OrderedDict()


def opened(name: str, block: int, moves: pa.StructArray, marks: pa.StructArray | None) -> tuple[Moves, dict[int, int], np.ndarray]:
    """The moves out of each edge, and the rows of edges in a table of their marks; the last blocks opened stay with
    the worker."""
    held = _kept.get((name, block))
    if held is None:
        row, table = {}, np.zeros((0, 0))
        if marks is not None and len(marks):
            row = {edge: k for k, edge in enumerate(marks.field("edge_id").to_pylist())}
            table = marks.field("marks").flatten().to_numpy(zero_copy_only=False).reshape(len(marks), -1)
        held = _kept[name, block] = Moves(moves), row, table
        while len(_kept) > KEPT:
            _kept.popitem(last=False)
    return held


def metres(a: float, b: float, lat: float, lon: float) -> float:
    x = sin(radians(lat - a) / 2) ** 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(lon - b) / 2) ** 2
    return 2 * P.EARTH_RADIUS_M * asin(min(1.0, sqrt(x)))


@dataclass
class Found:
    """What one request makes of a block."""

    n: int = 0
    waits: float | None = None
    #: The least that a label which left the block comes to, with what is left.
    gone: float | None = None
    goal: dict | None = None
    mail: dict[int, list[dict]] = field(default_factory=dict)
    labels: list[dict] = field(default_factory=list)


def search(block: int, moves: Moves, ask: dict, limits: Limits, marked: dict[int, int], marks: np.ndarray) -> Found:
    """All labels of a block by order of cost (and the least that is left: the straight way, or by landmarks), from
    all letters that came in.

    A label is final when it is taken: of one edge and bucket only the first, or in the exact form each that spent
    less than those before. At a tie the one that spent less comes first. Labels beyond the request's ``horizon`` wait
    for a run with a wider one; ``waits`` is the least of them. Where the request knows what a way back in spends at least
    (``need``), labels that leave with too much spent don't count as gone."""
    factor = {x["edge"]: x["factor"] for x in ask["factors"] or ()}
    goal, place, bound, need = ask["goal"], (ask["goal_lat"], ask["goal_lon"]), ask["bound"], ask.get("need", 0.0)
    bound = min(inf if bound is None else bound, limits.most_cost + 1e-9)
    guided, ahead = None not in place, {}
    out, letters, horizon, waits = Found(), ask["letters"], inf if ask["horizon"] is None else ask["horizon"], inf

    towards = None if ask["marks"] is None or not len(marks) else np.array(ask["marks"])

    def left(edge: int, lat: float | None, lon: float | None) -> float:
        """Less than what is left by a thousandth, so that rounding never makes the order wrong."""
        least = ahead.get(edge)
        if least is None:
            least = 0.0 if not guided or lat is None else metres(lat, lon, *place)
            if towards is not None and edge in marked:
                with np.errstate(invalid="ignore"):  # a landmark that knows neither says nothing
                    far = float(np.fmax.reduce(towards - marks[marked[edge]]))
                least = max(least, far) if far == far else least
            ahead[edge] = least = 0.999 * least
        return least

    taken: list[tuple[int, int, int]] = []  # edge, the label before, the letter it began with
    first: dict = {}  # the least spent of each state so far
    leaving: dict[int, dict[tuple, tuple]] = {}
    begun = (lambda edge: 0.0) if towards is None else (lambda edge: left(edge, None, None))
    heap = [(x["cost"] + begun(x["edge"]), x["cost"], x["used"], x["edge"], -1, k, x["length"], x["to_node"]) for k, x in enumerate(letters)]
    heapq.heapify(heap)

    def letter(edge: int, node: int, cost: float, used: float, length: float, back: int, own: list[int]) -> dict:
        """A label with the letter that its way through the block began with, and the edges since."""
        if not limits.keep_paths:
            return {"edge": edge, "to_node": node, "cost": cost, "used": used, "length": length, "p_edge": None, "p_used": None, "p_src": None, "seg": None}
        k = back
        while taken[k][1] >= 0:
            own.append(taken[k][0])
            k = taken[k][1]
        began = letters[taken[k][2]]
        return {"edge": edge, "to_node": node, "cost": cost, "used": used, "length": length, "p_edge": began["edge"], "p_used": began["used"], "p_src": began["src"], "seg": own[::-1]}

    while heap:
        f, cost, used, edge, back, entry, length, node = heapq.heappop(heap)
        if cost > bound or f == inf:
            continue
        if f > horizon:
            waits = min(waits, f)
            break  # so do all the others
        if limits.alone and (f > bound or (out.gone is not None and f >= out.gone)):
            break
        state = edge if limits.exact else (edge, limits.bucket(used))
        if state in first and (not limits.exact or used >= first[state]):
            continue
        first[state] = used
        here = len(taken)
        taken.append((edge, back, entry))
        if limits.keep_labels:
            out.labels.append(letter(edge, node, cost, used, length, here, []))
        if node == goal:
            if out.goal is None or cost < out.goal["cost"]:
                out.goal = letter(edge, node, cost, used, length, here, [])
                bound = min(bound, cost)
            continue
        for to, to_node, edge_cost, turn, spent, metres_of, to_block, lat, lon in moves.get(edge, ()):
            u = used + spent
            if limits.budget_m is not None and u > limits.budget_m:
                continue
            c = cost + turn + edge_cost * factor.get(to, 1.0)
            f = c + left(to, lat, lon)
            if f > bound or f == inf:  # too dear, or no way leads there
                continue
            if f > horizon:
                waits = min(waits, f)
                continue
            if to_block == block:
                done = first.get(to if limits.exact else (to, limits.bucket(u)))
                if done is None or (limits.exact and u < done):
                    heapq.heappush(heap, (f, c, u, to, here, entry, length + metres_of, to_node))
            else:
                if limits.budget_m is None or u + need <= limits.budget_m:
                    out.gone = f if out.gone is None else min(out.gone, f)
                box = leaving.setdefault(to_block, {})
                key = (to, u) if limits.exact else (to, limits.bucket(u))
                new = (c, u, length + metres_of, here, to_node)
                if key not in box or new < box[key]:
                    box[key] = new
    out.n, out.waits = len(taken), waits if waits <= bound and waits < inf else None
    for dst, box in () if limits.alone else leaving.items():
        rows = []
        least: dict[int, float] = {}
        for (to, _), (c, u, m, back, to_node) in sorted(box.items(), key=lambda kv: (kv[0][0], kv[1])):
            if limits.exact and u >= least.get(to, inf):
                continue
            least[to] = u
            rows.append(letter(to, to_node, c, u, m, back, [to]))
        out.mail[dst] = rows
    return out


def runner(name: str, number: int, limits: Limits, schema: pa.Schema):
    """For mapInArrow: rows of a block's moves and the requests that meet it, to what each of them makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = b.column("block")[k].as_py()
                moves, marked, marks = opened(name, block, b.column("moves")[k].values, b.column("marks")[k].values)
                rows = []
                for ask in b.column("asks")[k].as_py():
                    got = search(block, moves, ask, limits, marked, marks)
                    mail = [{"dst": d, "digest": digest(x), "letters": x} for d, x in sorted(got.mail.items())]
                    before, now = ({x["dst"]: x["digest"] for x in own} for own in (ask["before"] or (), mail))
                    least = min((x for x in (ask["bound"], got.goal and got.goal["cost"]) if x is not None), default=None)
                    changed = sorted(d for d in before.keys() | now.keys() if before.get(d) != now.get(d))
                    rows.append({"round": number, "query_id": ask["query_id"], "block": block, "bound": least, "waits": got.waits, "n_labels": got.n, "goal": got.goal, "mail": mail, "changed": changed, "labels": got.labels})
                    if len(got.labels) > SENT:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def digest(letters: list[dict]) -> int:
    """A number that letters of equal sums share."""
    return hash(tuple((x["edge"], x["cost"], x["used"], x["length"]) for x in letters))
