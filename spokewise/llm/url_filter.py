"""URL filters as of the time of fetching.

Dated list entries (a value is added to a list, or removed from it) become validity intervals, and every
capture is held against the intervals that were open when it was fetched. Domains are matched once for each
distinct host, not for each capture, so a host with a third of all captures is one small row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host of an absolute URL, in lower case without user, port or last dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of an absolute URL without query and fragment; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(host: Column, path: Column) -> Column:
    """The host with each whole-segment prefix of the path: ``h/a``, ``h/a/b`` and so on."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``list, kind, value, since, until`` (open end: null) from ``list, kind, value, at, listed``.

    An entry holds from its time to the next one of the same list, kind and value. Of several at one time
    a removal counts. Entries with a null value or time are skipped; values are matched in lower case.
    """
    clean = entries.select("list", "kind", F.lower("value").alias("value"), "at", F.coalesce("listed", F.lit(False)).alias("listed")).where("value IS NOT NULL AND at IS NOT NULL")
    events = clean.groupBy("list", "kind", "value", "at").agg(F.min("listed").alias("listed"))
    order = Window.partitionBy("list", "kind", "value").orderBy("at")
    return events.withColumn("until", F.lead("at").over(order)).where("listed").select("list", "kind", "value", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The lists that named each capture when it was fetched: ``id, url, fetched_at, host, hits, blocked``.

    ``entries``: ``list, kind, value, at, listed``; kind ``domain`` matches a host and all under it, kind
    ``url`` a host with path segments, and all that begins with them. ``hits`` are the sorted distinct
    ``list:value`` of open intervals (since <= fetched_at < until). One row for each capture, repeated ones
    too; a null or relative URL, or a null time, has no hits; no entries block nothing.
    """
    spans = validity(entries)
    held = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"), host_of(F.col(url_col)).alias("host"))
    hosts = held.where("host IS NOT NULL").select("host").distinct()
    label = F.concat_ws(":", "list", "value").alias("label")
    domains = spans.where("kind = 'domain'").select("value", "since", "until", label)
    by_host = (
        hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("value"))
        .join(domains, "value")
        .groupBy("host")
        .agg(F.collect_list(F.struct("label", "since", "until")).alias("named"))
    )
    urls = spans.where("kind = 'url'").select("value", "since", "until", label)
    key = ["url", "fetched_at"]
    by_url = (
        held.where("fetched_at IS NOT NULL AND host IS NOT NULL")
        .select(*key, "host")
        .distinct()
        .select(*key, F.explode(path_prefixes(F.col("host"), F.lower(path_of(F.col("url"))))).alias("value"))
        .join(urls, "value")
        .where("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
        .groupBy(*key)
        .agg(F.collect_set("label").alias("paths"))
    )
    open_now = F.filter("named", lambda x: (x.since <= F.col("fetched_at")) & (x.until.isNull() | (F.col("fetched_at") < x.until)))
    none = F.array().cast("array<string>")
    hits = F.array_sort(F.array_union(F.coalesce(F.transform(open_now, lambda x: x.label), none), F.coalesce("paths", none)))
    # written, so that both sides of the joins are dealt anew, and a host's captures can be split
    out = held.join(stash(by_host, "hosts"), "host", "left").join(stash(by_url, "urls"), key, "left")
    return out.select("id", "url", "fetched_at", "host", hits.alias("hits")).withColumn("blocked", F.size("hits") > 0)
