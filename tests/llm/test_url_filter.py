"""Dated lists, held against captures one by one."""

import datetime as dt

from spokewise.llm import queries, url_filter
from tests.oracle import compare

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def hits(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, value string")
    e = spark.createDataFrame(entries, "list string, kind string, value string, at timestamp, listed boolean")
    return sorted(((r.id, list(r.hits), r.blocked) for r in url_filter.filter_urls(c, e).collect()), key=str)


def test_intervals(spark):
    entries = [
        ("adult", "domain", "Bad.example", DAY(10), True), ("adult", "domain", "bad.example", DAY(20), False), ("adult", "domain", "bad.example", DAY(30), True),
        ("ads", "domain", "example", DAY(40), True), ("ads", "url", "ok.test/a/b", DAY(5), True), ("ads", "url", "ok.test/a/b", DAY(6), True), ("ads", "url", "ok.test/a/b", DAY(6), False),
        ("ads", "domain", None, DAY(1), True), ("ads", "domain", "x.test", None, True),
    ]
    captures = [
        (1, "http://bad.example/", DAY(9), "v"), (2, "https://u:p@www.BAD.example.:80/x?y", DAY(10), "v"), (3, "http://bad.example", DAY(20), "v"), (4, "http://a.bad.example/", DAY(41), "v"),
        (5, "http://notbad.example/", DAY(41), "v"), (6, "http://ok.test/A/b/c", DAY(5), "v"), (7, "http://ok.test/a/bc", DAY(5), "v"), (8, "http://ok.test/a/b", DAY(6), "v"),
        (9, None, DAY(5), "v"), (10, "/relative", DAY(5), "v"), (11, "http://bad.example/", None, "v"), (1, "http://bad.example/", DAY(9), "v"),
    ]
    want = [
        (1, [], False), (1, [], False), (2, ["adult:bad.example"], True), (3, [], False), (4, ["ads:example", "adult:bad.example"], True), (5, ["ads:example"], True),
        (6, ["ads:ok.test/a/b"], True), (7, [], False), (8, [], False), (9, [], False), (10, [], False), (11, [], False),
    ]
    assert hits(spark, captures, entries) == sorted(want, key=str)
    assert hits(spark, captures[:2], []) == [(1, [], False), (2, [], False)]
    assert hits(spark, [], entries) == []


def test_query(spark, sf, sf_more):
    assert compare(spark, queries.op5_url_filter, queries.OP5_SQL, sf)
    assert compare(spark, queries.op5_url_filter, queries.OP5_SQL, sf_more)
