"""Removal of repeated windows against a look at every window."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from spokewise.llm import queries, recompression, repeats, suffix_dedup


def bytes_kept(rows, window):
    first = {}
    docs = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: x[0])
    for i, t in docs:
        for s in range(len(t) - window + 1):
            first.setdefault(t[s : s + window], (i, s))
    out = {}
    for i, t in docs:
        hit = [False] * len(t)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < (i, s):
                hit[s : s + window] = [True] * window
        out[i] = (len(t), sum(hit), sum(h and not p for h, p in zip(hit, [False, *hit])), bytes(c for c, h in zip(t, hit) if not h))
    return out


def words_kept(rows, window):
    count = defaultdict(int)
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for _, w in docs:
        for s in range(len(w) - window + 1):
            count[tuple(w[s : s + window])] += 1
    out = {}
    for i, w in docs:
        hit = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                hit[s : s + window] = [True] * window
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h))
    return out


def made(seed, letters, join):
    """Texts that share, shift, overlap and repeat passages."""
    r = random.Random(seed)
    text = lambda n: join.join(r.choice(letters) for _ in range(n))
    shared = [text(r.randrange(5, 150)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else text(r.randrange(0, 60)) for _ in range(r.randrange(1, 7))]
        rows.append((i, join.join(parts)))
    rows += [(60, None), (61, ""), (62, join.join("a" * 500)), (63, join.join("ab" * 300)), (64, rows[3][1]), (65, join.join(["xy"] * 300)), (66, text(3000)), (67, " \t\n é ü ")]
    return rows


@pytest.mark.parametrize(("seed", "window", "letters"), [(1, 100, "abcdef"), (2, 20, "ab"), (3, 40, "abé "), (4, 9, "abc")])
def test_bytes(spark, seed, window, letters):
    rows = made(seed, letters, "")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.id: (r.n_bytes, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r.spans) // 2, bytes(r.kept)) for r in suffix_dedup.drop_repeats(docs, window=window).collect()}
    assert got == bytes_kept(rows, window)


@pytest.mark.parametrize(("seed", "window", "letters"), [(1, 35, ["a", "b", "cc", "dé", "e"]), (2, 10, ["a", "b"]), (3, 35, ["a", "b"]), (4, 3, ["x", "y", "z"])])
def test_words(spark, seed, window, letters):
    rows = made(seed, letters, " ")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(5)
    got = {r.id: (r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.kept) for r in recompression.drop_repeats(docs, window=window).collect()}
    assert got == words_kept(rows, window)


def test_hot_keys_and_small_flushes(spark, monkeypatch):
    """Frequent keys take the other way, with the same result."""
    monkeypatch.setattr(repeats, "hot_keys", lambda rows, finder, share: [k for r in rows.collect() for k in finder()(*repeats.flat_bytes(repeats.pa.array([r.text]))).key.tolist() if k % 3])
    monkeypatch.setattr(repeats, "SETTLED", 50)
    monkeypatch.setattr(repeats, "HELD", 400)
    rows = made(5, "abcd", "")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: bytes(r.kept) for r in suffix_dedup.drop_repeats(docs, window=30).collect()}
    assert got == {i: x[3] for i, x in bytes_kept(rows, 30).items()}
    rows = made(6, ["a", "b", "c"], " ")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.kept for r in recompression.drop_repeats(docs, window=12).collect()}
    assert got == {i: x[2] for i, x in words_kept(rows, 12).items()}


def versions_kept(rows, window):
    """Bytes kept of each row, where ids may stand on several rows: earlier is a smaller id, or the same and a smaller start."""
    texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for s in range(len(t) - window + 1):
            x = t[s : s + window]
            first[x] = min(first.get(x, (i, s)), (i, s))
    out = []
    for i, t in texts:
        hit = [False] * len(t)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < (i, s):
                hit[s : s + window] = [True] * window
        out.append((i, bytes(c for c, h in zip(t, hit) if not h)))
    return sorted(out)


def places_kept(rows, window):
    """Words kept of each row, where a window of any two places goes."""
    texts = [(-1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = defaultdict(int)
    for _, w in texts:
        for s in range(len(w) - window + 1):
            count[tuple(w[s : s + window])] += 1
    out = []
    for i, w in texts:
        hit = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                hit[s : s + window] = [True] * window
        out.append((i, " ".join(x for x, h in zip(w, hit) if not h)))
    return sorted(out)


@pytest.mark.parametrize("splits", [1, 4])
def test_empty_null_and_repeated_rows(spark, splits):
    """Rows that share an id, with one text or several of different lengths."""
    schema = "doc_id long, text string"
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], schema)).count() == 0
    assert recompression.drop_repeats(spark.createDataFrame([], schema)).count() == 0
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "wz")
    rows = [(1, one), (1, one), (None, one), (None, None), (2, two), (2, "ab ab"), (2, f"x {two} y {one}"), (3, two), (3, f"q {two}"), (3, "")]
    docs = spark.createDataFrame(rows, schema).repartition(splits)
    back = lambda i: -1 if i is None else i
    for window in (100, 20):
        assert sorted((back(r.id), bytes(r.kept)) for r in suffix_dedup.drop_repeats(docs, window=window).collect()) == versions_kept(rows, window)
    for window in (35, 9):
        assert sorted((back(r.id), r.kept) for r in recompression.drop_repeats(docs, window=window).collect()) == places_kept(rows, window)


def test_long_texts(spark):
    """A text of 1.5 MB, one that repeats it within another, and a long run of one letter."""
    r = random.Random(8)
    long = " ".join(r.choice("abcdefghijkl") * r.randrange(1, 5) for _ in range(400_000))
    rows = [(1, long), (2, f"before {long[200_000:900_000]} after"), (3, "a" * 300_000), (4, "b " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.id: bytes(x.kept) for x in suffix_dedup.drop_repeats(docs).collect()}
    assert got[1] == long.encode() and got[3] == b"a" and len(got[2]) < 40 and got[4] == b"b "
    kept = {x.id: x.kept for x in recompression.drop_repeats(docs).collect()}
    assert kept[4] == "" and kept[3] == "a" * 300_000 and len(kept[2]) < 60


def test_queries_on_a_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, sf).collect()}
    assert got == {i: (n, m, s, sha(k)) for i, (n, m, s, k) in bytes_kept(docs, 100).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_recompression(spark, sf).collect()}
    assert got == {i: (n, m, sha(k.encode())) for i, (n, m, k) in words_kept(docs, 35).items()}
