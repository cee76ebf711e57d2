"""The kernel against its definition, and held-out accuracy of the model."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spokewise.llm import queries, toxicity
from spokewise.llm.windows import flat_bytes


def plain_kernel(a: str, b: str) -> float:
    """Shared three-letter subsequences, each by its spans, with a border letter at either end."""

    def parts(s):
        s = f"\0{s}\0"
        out, total = {}, 0.0
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                w = toxicity.DECAY ** (k - i + 1)
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + w
                total += w * w
        return out, total**0.5

    (x, nx), (y, ny) = parts(a), parts(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / nx / ny


def test_kernel():
    r = random.Random(2)
    some = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 20))) for _ in range(12)]
    flat, off = flat_bytes(pa.array(some))
    m = toxicity.letters(flat, off[:-1], off[1:])
    code, owner, weight = toxicity.features(m)
    for j, b in enumerate(some):
        table = np.zeros(1 << 18)
        np.add.at(table, code[owner == j], weight[owner == j])
        assert toxicity.folded(m, table) == pytest.approx([plain_kernel(a, b) for a in some])


def test_units():
    texts = ['Oh, (idiot)!  "x"', "i d i o t s", None, "", " ... ", "z" * 60]
    flat, off = flat_bytes(pa.array(texts))
    start, end, row = toxicity.unit_places(flat, off)
    got = [(int(r), flat[a:b].tobytes().decode()) for a, b, r in zip(start, end, row)]
    assert got[:4] == [(0, "Oh"), (0, "idiot"), (0, "x"), (1, "i d i o t s")]
    assert {r for r, _ in got[4:]} == {5} and sum(len(w) for _, w in got[4:]) >= 60


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 9)))
    texts, toxic = [], []
    for i in range(300):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[r.randrange(40)] = r.choice(["blockhead", "dimwit", "numskull"])
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 3 == 0))
    return toxicity.fit(texts, toxic)


def test_inserted_letters(model):
    score = lambda x: float(model.scores(*flat_bytes(pa.array([x])))[0])
    for bad in ("you blockhead", "what a DIMWIT!", "numskull", "a blockhxead here", "numskkull"):
        assert score(bad) > 0.7, bad
    for good in ("a line of tiles", "", "numerous skills at lunch"):
        assert score(good) < 0.5, good


def test_whole_texts_and_odd_rows(spark, model):
    far = "tree " * 40_000 + "dimwit"
    rows = [(1, far, 9.0), (1, far, 9.0), (2, None, None), (None, "dimwit", 1.0), (3, "", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((r.id or 0, r.score > 0.7) for r in toxicity.score_texts(docs, model).collect())
    assert got == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(False))
    assert [r.score for r in toxicity.score_texts(docs, model).collect()] == [0.5]


def test_fitted_in_a_task(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["tiles", "lines", "sun", "oar", "net", "rose"], k=6)) + (" dimwit" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, rows[1][1]), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(99, 1)], "doc_id long, toxic int")
    want = toxicity.fit([t for _, t in rows], [int(i % 3 == 0) for i, _ in rows])
    monkeypatch.setattr(toxicity, "fit", lambda *_: pytest.fail("the driver fits"))
    got = toxicity.train(docs, labels, F.lit(False))
    assert got.table == pytest.approx(want.table) and (got.bias, got.slope, got.shift) == pytest.approx((want.bias, want.slope, want.shift))


def test_words_of_texts():
    texts = [f"one two{k % 7} one x{k}" for k in range(250)]
    row, word, shapes = toxicity.words_of_texts(texts)
    assert len(shapes) == len({w for t in texts for w in t.split()}) == len({bytes(x) for x in shapes}) and np.bincount(row).tolist() == [3] * 250
    flat, off = flat_bytes(pa.array(texts))
    start, end, at = toxicity.unit_places(flat, off)
    for k, x in enumerate(toxicity.letters(flat, start, end)):
        assert bytes(x) in {bytes(shapes[w]) for w in word[row == at[k]]}


def test_held_out_accuracy(spark, sf_more):
    found = queries.op3_toxicity(spark, sf_more).where("held_out").join(queries.table(spark, sf_more, "labels").select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in found)
    clean = [r for r in found if not r.toxic]
    assert right / len(found) > 0.88 and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in found if a.toxic for b in clean]
    assert sum(pairs) / len(pairs) > 0.8
