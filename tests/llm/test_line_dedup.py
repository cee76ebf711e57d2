"""Line dedup against a plain way, written on its own: partners by looking at all texts, a recursive patience diff."""

import hashlib
import random
import time

from spokewise.llm import queries
from spokewise.llm.line_dedup import drop_common_lines, patience

BLANK = " \t\n\v\f\r"


def lcs_order(pairs):
    """The longest rising chain of pairs, in quadratic time; ties go as in the usual card game."""
    piles = []
    for pair in pairs:  # by place in b
        for pile in piles:
            if pile[-1][0] >= pair[0]:
                break
        else:
            pile = []
            piles.append(pile)
        before = piles[piles.index(pile) - 1] if piles.index(pile) else None
        pile.append((pair[0], pair[1], before[-1] if before else None))
    out, x = [], piles[-1][-1] if piles else None
    while x:
        out.append((x[0], x[1]))
        x = x[2]
    return out[::-1]


def diffed(a, b, i=0, j=0):
    """Patience diff of lists of lines, by its definition."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j)] + diffed(a[1:], b[1:], i + 1, j + 1)
    if a[-1] == b[-1]:
        return diffed(a[:-1], b[:-1], i, j) + [(i + len(a) - 1, j + len(b) - 1)]
    chain = lcs_order([(a.index(x), k) for k, x in enumerate(b) if a.count(x) == 1 and b.count(x) == 1])
    if not chain:
        return []
    out, x, y = [], 0, 0
    for p, q in [*chain, (len(a), len(b))]:
        out += diffed(a[x:p], b[y:q], i + x, j + y)
        if p < len(a):
            out.append((i + p, j + q))
        x, y = p + 1, q + 1
    return out


def lost(a, b):
    """Places of ``b`` in blocks aligned with ``a``."""
    blocks = []
    for i, j in sorted(diffed(a, b)):
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    return {j for block in blocks if any(b[j].strip(BLANK) for _, j in block) for _, j in block}


def brute(rows, rare=6):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if t is not None):
        first.setdefault(t, i)
    docs = {i: t.split("\n") for t, i in first.items()}

    def holders(run):
        n = len(run)
        return [k for k in sorted(docs) if any(docs[k][s : s + n] == run for s in range(len(docs[k]) - n + 1))]

    known = {}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines = t.split("\n")
        if first[t] != i:
            gone = set(range(len(lines))) if t.strip(BLANK) else set()
        else:
            held = lambda run: known.setdefault(tuple(run), None) or known.update({tuple(run): holders(run)}) or known[tuple(run)]
            runs = [[x] for x in lines]
            size = 2
            while size <= len(lines):
                runs += [lines[s : s + size] for s in range(len(lines) - size + 1) if all(len(held([x])) > rare for x in lines[s : s + size])]
                size *= 2
            near = set()
            for run in runs:
                if any(x.strip(BLANK) for x in run):
                    own = held(run)
                    near.update(own if len(own) <= rare else own[:1])
            gone = set().union(*(lost(docs[k], lines) for k in near if k < i), set())
        out[i] = (len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def aligned(a, b):
    return sorted(patience(a, list(range(len(a))), len(a), b, list(range(len(b))), len(b)))


def test_patience():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(r.choice([3, 40])) for _ in range(r.randrange(15))] for _ in range(2))
        assert aligned(a, b) == sorted(diffed(a, b))
        # lines that the other one can't have may be left out, if their places stay
        few = [[(k, x) for k, x in enumerate(own) if x in other] for own, other in ((a, b), (b, a))]
        (pa, xa), (pb, xb) = (tuple(map(list, zip(*f))) if f else ([], []) for f in few)
        assert sorted((pa[i], pb[j]) for i, j in patience(xa, pa, len(a), xb, pb, len(b))) == sorted(diffed(a, b))


def made(seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["tree", "bird", "stone", "hill", "sea"]) for _ in range(r.randrange(1, 9)))
    pool = [line() for _ in range(40)] + ["", "end", "licence: free for all of us to use"]
    rows = []
    for i in range(50):
        text = [r.choice(pool) if r.random() < 0.5 else line() for _ in range(r.randrange(1, 25))]
        if rows and r.random() < 0.4 and rows[-1][1]:
            text = rows[r.randrange(len(rows))][1].split("\n") + text[:3]
        rows.append((i, "\n".join(text)))
    return rows + [(50, None), (51, ""), (52, rows[0][1]), (53, "\n\n"), (54, "été à la mer et encore\nété à la mer et encore"), (55, "x\nété à la mer et encore"), (56, ""), (57, " \n\t")]


def found(df):
    return {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in df.collect()}


def test_against_plain_way(spark):
    for seed, rare in ((1, 6), (2, 2)):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, [i], "g", 7) for i, t in rows], "doc_id long, text string, lines array<int>, gone string, n_lines int").repartition(4)
        got = drop_common_lines(docs, rare=rare)
        assert got.columns == ["doc_id", "text", "lines", "gone", "n_lines", "n_deleted"]
        assert found(got) == brute(rows, rare)


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in drop_common_lines(docs).orderBy("doc_id").collect()]


def test_later_holders(spark):
    """Copies and blocks of a document whose lines stand in another order in the first holder."""
    x, y = ("the x line", "the y line")
    assert kept(spark, [f"{x}\n{y}", f"{y}\n{x}", f"{y}\n{x}", f"{y}\n{x}\nnew"])[2:] == ["", "new"]
    r = random.Random(4)
    pool = [f"line {k} of the passages that many share" for k in range(12)]
    texts = ["\n".join(r.sample(pool, 12)) for _ in range(20)]
    got = kept(spark, [*texts, *texts, *(f"{t}\nnew at the end {k}" for k, t in enumerate(texts))])
    assert got[20:] == [""] * 20 + [f"new at the end {k}" for k in range(20)]
    assert got[0] == texts[0]


def test_short_lines(spark):
    verse = "so much depends\nupon\n\na red wheel\nbarrow"
    assert kept(spark, [verse, verse, "x\n" + verse, "upon", "", "  ", "a\n\nb", "c\n\nd"]) == [verse, "", "x", "", "", "  ", "a\n\nb", "c\n\nd"]


def test_long_texts_in_linear_time(spark):
    """One line repeated, in 20 documents, and a text of 2 MB."""
    took = {}
    for n in (500, 4_000):
        start = time.perf_counter()
        got = kept(spark, ["again and again\n" * n + f"own {k}" for k in range(20)])
        took[n] = time.perf_counter() - start
        assert got[1:] == [f"\nown {k}".removeprefix("\n") for k in range(1, 20)]
    assert took[4_000] < 4 * took[500] + 10
    long = "\n".join(f"line {k} of a long text, which goes on" for k in range(60_000))
    assert kept(spark, [long, "a new start\n" + long])[1] == "a new start"


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert drop_common_lines(spark.createDataFrame([], schema)).count() == 0
    text = "one line\nand another one"
    docs = spark.createDataFrame([(2, text), (2, text), (2, "one line\nnew"), (None, text), (3, text + "\nmore"), (None, None)], schema)
    got = sorted(((r.doc_id or 0, r.text or "") for r in drop_common_lines(docs, counts=False).collect()), key=str)
    assert got == [(0, ""), (0, text), (2, ""), (2, ""), (2, "new"), (3, "more")]


def test_hot_groups(spark):
    """Most rows are copies, or share one line."""
    texts = ["the same\ntext"] * 700 + [f"a line of all\nown {k}" for k in range(700)]
    assert kept(spark, texts) == ["the same\ntext"] + [""] * 699 + ["a line of all\nown 0"] + [f"own {k}" for k in range(1, 700)]


def test_query_on_small_tables(spark, sf, sf_more):
    for folder in (sf, sf_more):
        rows = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
        want = {i: (n, m, hashlib.sha256((t or "").encode()).hexdigest()) for i, (n, m, t) in brute(rows).items()}
        assert {r.doc_id: (r.n_lines, r.n_deleted, r.kept_sha256) for r in queries.op2_line_dedup(spark, folder).collect()} == want
