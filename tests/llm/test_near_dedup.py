"""Near-duplicate groups against all pairs."""

import random
import re

from spokewise.llm import near_dedup, queries

UPPER = {i: i + 32 for i in range(65, 91)}


def set_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    rows = sorted((i, set_of(t, width)) for i, t in rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in rows}


def made(seed, n_bases=12, per=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(1, 5)))
    common = [word() for _ in range(30)]
    rows = []
    for _ in range(n_bases):
        base = [word() for _ in range(r.choice([3, 8, 40, 150]))]
        for _ in range(r.randrange(1, per)):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w + common
            rows.append((len(rows), " ".join(w).capitalize()))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a"), (n + 4, "A"), (n + 5, "a b c"), (n + 6, "b a c")]


def collected(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_all_pairs(spark):
    rows = made(1)
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    assert collected(near_dedup.near_duplicates(docs)) == brute(rows, 5)


def test_small_nodes_and_families(spark):
    """Large nodes are branched further and large families met node by node."""
    rows = made(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(near_dedup.near_duplicates(docs, width=4, node=6, part=6, family=400)) == brute(rows, 4)


def test_pairs_in_large_nodes(spark):
    """Pairs at the threshold that have little but a template in common, which all other documents have too."""
    rows = []
    for pair in range(100):
        both = [f"t{k}" for k in range(203)] + [f"p{pair}w{k}" for k in range(10)]
        rows += [(len(rows) + side, " ".join(both + [f"p{pair}s{side}w{k}" for k in range(26)])) for side in range(2)]
    want = brute(rows, 4)
    assert len({c for _, c, _ in want.values()}) == 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(near_dedup.near_duplicates(docs, width=4, node=2, part=10, family=5_000)) == want


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None)], schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, None, False), (5, 2, None, False), (None, 2, None, True), (7, 0, 7, True), (None, 0, None, True)], key=str)


def test_query_on_small_tables(spark, sf, sf_more):
    for folder in (sf, sf_more):
        docs = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
        assert collected(queries.op4_near_dedup(spark, folder)) == brute(docs, 4)


def test_versions_of_one_document(spark):
    """Rows that share an id are one document, so texts of either are linked with it."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, one), (4, one), (4, two), (7, two), (9, three), (9, "z " + three), (5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (4, 1, False), (4, 1, False), (5, 5, True), (7, 1, False), (9, 9, True), (9, 9, True)]


def test_recall_by_depth(spark):
    """Of pairs at the threshold whose nodes are branched again and again, some child takes nearly all."""
    rows = []
    for pair in range(150):
        both = [f"t{k}" for k in range(103)] + [f"p{pair}w{k}" for k in range(110)]
        rows += [(len(rows) + side, " ".join(both + [f"p{pair}s{side}w{k}" for k in range(26)])) for side in range(2)]
    assert 0.79 < len(set_of(rows[0][1], 4) & set_of(rows[1][1], 4)) / len(set_of(rows[0][1], 4) | set_of(rows[1][1], 4)) < 0.82
    docs = spark.createDataFrame(rows, "doc long, text string")
    marked = docs.mapInArrow(lambda b: near_dedup.signed(b, 4), "doc long, n long, s1 long, s2 long, sketch binary, minima array<int>")
    reps = near_dedup.stash(marked.select("doc", "minima"), "reps")
    for depth in (0, 3, 6):
        met = near_dedup.nodes_of(reps, 2, depth)  # branched while a node holds more than a pair
        pairs = {(r.a, r.b) for r in met.alias("x").join(met.alias("y"), "key").selectExpr("x.doc AS a", "y.doc AS b").where("a < b AND a % 2 = 0 AND b = a + 1").collect()}
        assert len(pairs) >= 149, depth
