"""Names of stretches: equal for equal ones only, patterned ones included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokewise.llm import line_dedup, near_dedup, recompression, suffix_dedup
from spokewise.llm.windows import PRIME, Sums, folded, picks, times


def patterned(n, a="a", b="b"):
    """A word of two letters, and the one with both exchanged, whose sums modulo 2**64 agree for every odd base."""
    of = lambda i: i.bit_count() & 1
    return "".join((a, b)[of(i)] for i in range(n)), "".join((b, a)[of(i)] for i in range(n))


def test_products_and_sums():
    r = random.Random(1)
    a, b = ([*(r.randrange(PRIME) for _ in range(500)), 0, 1, PRIME - 1, PRIME - 1] for _ in range(2))
    assert times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % PRIME for x, y in zip(a, b)]
    x = [0, PRIME, PRIME + 1, 2**64 - 1, r.randrange(2**64)]
    assert folded(np.array(x, np.uint64)).tolist() == [v % PRIME for v in x]


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_equal_stretches_have_equal_names(kind):
    r = np.random.default_rng(3)
    x = r.integers(0, 3, 3000).astype(kind)
    sums = Sums(x)
    start = r.integers(0, 2990, 4000)
    end = np.minimum(start + r.integers(0, 10, 4000), 3000)
    names: dict = {}
    for s, e, v in zip(start.tolist(), end.tolist(), sums.of(start, end).tolist()):
        assert names.setdefault(bytes(x[s:e]), v) == v
    assert len(set(names.values())) == len(names)
    other = Sums(np.r_[x[7:], x[:7]]).of(np.array([3]), np.array([900]))
    assert other == sums.of(np.array([10]), np.array([907])) and Sums(x, 1).of(np.array([0]), np.array([5])) != sums.of(np.array([0]), np.array([5]))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 1 << 16])
def test_patterned_words(n):
    one, two = patterned(n)
    flat = np.frombuffer((one + two).encode(), np.uint8)
    for which in (0, 1):
        assert len(set(Sums(flat, which).of(np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
        names = Sums(flat.astype(np.uint64) << np.uint64(40), which).of(np.array([0, n]), np.array([n, 2 * n]))
        assert names[0] != names[1]


def test_picks():
    flat = np.frombuffer(b"abcabcxbcabc", np.uint8)
    p = picks(flat, 3)
    assert p[0] == p[3] == p[9] and len(p) == 10 and len(picks(flat, 13)) == 0


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize("n", [2048, 4096])
def test_operators_tell_patterned_words_apart(spark, n):
    one, two = patterned(n)
    lines = line_dedup.drop_common_lines(docs(spark, [f"{one}\nown a", f"{two}\nown b", f"{one}\nown c"]))
    assert [r.n_deleted for r in lines.orderBy("doc_id").collect()] == [0, 0, 1]
    near = near_dedup.near_duplicates(docs(spark, [one, two, one]), width=4).orderBy("doc_id")
    assert [r.component_id for r in near.collect()] == [1, 2, 1]
    shared = " ".join(f"w{i}" for i in range(34))
    removed = recompression.drop_repeats(docs(spark, [f"{shared} {one}", f"{shared} {two}"])).where(F.size("spans") > 0)
    assert removed.isEmpty()
    words = [" ".join(x) for x in patterned(n)]  # shingles of one letter are alike, whole sequences are not
    removed = recompression.drop_repeats(docs(spark, words), window=n)
    assert removed.where(F.size("spans") > 0).isEmpty()
    assert suffix_dedup.drop_repeats(docs(spark, [one, two]), window=n).where(F.size("spans") > 0).isEmpty()
