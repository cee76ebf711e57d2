"""Fill-in-the-middle against slicing of whole lists of units, and back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spokewise.llm import fill_middle as fim
from spokewise.llm import queries
from tests.oracle import compare

CASES = "doc_id long, text string, lang string, output string, form string"


def brute(i, text, unit=fim.CODE_POINT):
    text = text or ""
    ends = [0, *(m.end() for m in (re.finditer(unit, text) if text else ()))]
    n = len(ends) - 1
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (ends[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(pre), len(mid), out


def texts():
    r = random.Random(3)
    letters = "ab <>PSM\n\ŕé𝒳 字"
    rows = [(i, "".join(r.choices(letters, k=r.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a<S>b"), (903, "<"), (904, "<P"), (905, "S><S"), (None, "no id"), (906, "x" * 400_000 + "é"), rows[5], (907, rows[5][1]), (-3, "\x00\n\x00")]
    return rows


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\S+", r"(?m:^.*\n?)", "z*"])
def test_brute_and_back(spark, unit):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "xx", "clash", "clash") for i, t in rows], CASES).repartition(3)
    got = fim.fill_middle(docs, unit).withColumn("back", fim.restored()).collect()
    want = sorted(map(repr, ((i, *brute(i, t, unit), t or "") for i, t in rows)))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_units_is_no_cut(spark):
    docs = spark.createDataFrame([(i, "   ") for i in range(30)], "doc_id long, text string")
    got = fim.fill_middle(docs, r"\S+").withColumn("back", fim.restored()).collect()
    assert all(r.n == 0 and r.back == "   " and not r.prefix_chars and not r.middle_chars for r in got)


def test_empty_table_and_sentinels(spark):
    assert fim.fill_middle(spark.createDataFrame([], CASES)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    docs = spark.createDataFrame([(i, "a.*b") for i in range(40)], "doc_id long, text string")
    marks = ("[.*", "[\\E", "[+")
    got = fim.fill_middle(docs, sentinels=marks).select(fim.restored(sentinels=marks).alias("back"), "form").collect()
    assert {r.back for r in got} == {"a.*b"} and len({r.form for r in got}) == 3


def test_cut_places():
    unit = re.compile(".")
    assert [fim.cut_places(unit, "abcdef", *c) for c in ((2, 2), (0, 6), (0, 0), (1, 4))] == [(2, 2), (0, 6), (0, 0), (1, 4)]
    assert fim.cut_places(unit, "", 0, 0) == (0, 0) and fim.count_units(unit, "abc") == 3 and fim.count_units(unit, "") == 0


def test_query(spark, sf):
    assert compare(spark, queries.op11_fill_middle, queries.OP11_SQL, sf)
    for f in (F.col("output_sha256"), F.col("restored_sha256")):
        assert queries.op11_fill_middle(spark, sf).where(f.isNull()).isEmpty()
