"""Benchmark windows against a look at every place."""

import random
import re

from spokewise.llm import decontaminate, queries
from spokewise.storage import names
from tests.oracle import compare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def hits(docs, items, window=10):
    """Words, hit words and items of each document."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w = words_of(text)
        hit, named = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    hit.update(range(s, s + n))
                    named |= got
        out[i] = (len(w), len(hit), sorted(named))
    return out


def digest(found):
    return {r.doc_id: (r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), list(r.items)) for r in found.collect()}


def made(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "Cc", "dé", "e7"])
    items = [(n, " ".join(word() for _ in range(r.choice([1, 2, 5, 10, 14])))) for n in range(8)] + [(100, None), (101, "!!"), (102, "zebra")]
    docs = []
    for i in range(60):
        parts = [r.choice(items)[1] or "" if r.random() < 0.3 else " ".join(word() for _ in range(r.randrange(30))) for _ in range(4)]
        docs.append((i, ", ".join(parts).upper() if i % 5 == 0 else "\n".join(parts)))
    return docs + [(60, None), (61, ""), (62, "ZEBRA"), (63, "b " * 3000)], items


def test_every_place(spark):
    for seed in range(3):
        docs, items = made(seed)
        d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        for block in (10**6, 8):
            assert digest(decontaminate.find_hits(d, b, block_words=block)) == hits(docs, items)
        kept = decontaminate.decontaminate(d, b, block_words=20)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in hits(docs, items).items() if not x[1]]


def test_one_block_at_a_time(spark, monkeypatch):
    """A block is sent only after what the one before found was written; steps and blocks in between are gone."""
    docs, items = made(7)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d = d.unionByName(d.where("doc_id = 1"))  # an id twice stays two rows
    b = spark.createDataFrame(items, "item_id long, text string")
    live, most = [], []
    send, written = spark.sparkContext.broadcast, len(names(spark))
    real = decontaminate.settled

    def settled(found, step, block):
        out = real(found, step, block)
        live.remove(id(block))
        return out

    def broadcast(value):
        sent = send(value)
        live.append(id(sent))
        most.append(len(live))
        return sent

    monkeypatch.setattr(decontaminate, "settled", settled)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: broadcast(value) if isinstance(value, decontaminate.ItemBlock) else send(value))
    found = decontaminate.find_hits(d, b, block_words=30)
    assert len(most) > 2 and max(most) == 1 and len(names(spark)) == written + 1
    assert found.count() == len(docs) + 1 and digest(found) == hits(docs, items)


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(13)) + " z"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(20)))], "item_id string, text string")
    assert {r.doc_id: r.longest for r in decontaminate.find_hits(d, b).collect()} == {1: 13, 2: 0}


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A B"), (1, "A B"), (None, "a")], "item_id long, text string")
    assert decontaminate.find_hits(docs.limit(0), items).count() == 0
    assert [r.spans for r in decontaminate.find_hits(docs, items.limit(0)).collect()] == [[], [], []]
    got = decontaminate.find_hits(docs, items).collect()
    assert [(list(r.spans), list(r.items)) for r in got] == [([0, 2], ["1"])] * 3


def test_query(spark, sf):
    assert compare(spark, queries.op8_decontaminate, queries.OP8_SQL, sf)
