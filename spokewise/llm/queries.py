"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fill_middle, line_dedup, near_dedup, piece_codec, recompression, suffix_dedup, token_counts, topk, toxicity, url_filter, whitening
from .common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the hosts and paths that occur in ``pages``.

    ``n`` is the number in the first four hex digits of a value's MD5. A host is listed on day n % 200 if
    n % 3 = 0, unlisted 30 + n % 50 days later if n is even, and listed again on day n % 200 + 120 if
    n % 7 = 0; its parent domain is listed on day n % 300 if n % 11 = 0. A host with its first two path
    segments is listed on day n % 250 if n % 5 = 0. Day 0 is 2023-01-01.
    """
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1672531200) + n * 86400).alias("at")
    entry = lambda kind, value, n, listed: (F.lit("rule").alias("list"), F.lit(kind).alias("kind"), value.alias("value"), day(n), F.lit(listed).alias("listed"))
    seen = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.lower(url_filter.path_of(F.col("url"))).alias("path"))
    hosts = seen.select("host").where("host IS NOT NULL").distinct().withColumn("n", number(F.col("host")))
    host, n = F.col("host"), F.col("n")
    parent = F.expr("substring(host, locate('.', host) + 1)")
    two = F.concat_ws("/", host, F.regexp_extract("path", "^/([^/]+/[^/]+)", 1))
    paths = seen.where(r"host IS NOT NULL AND path RLIKE '^/[^/]+/[^/]+'").select(two.alias("host")).distinct().withColumn("n", number(F.col("host")))
    return (
        hosts.where("n % 3 = 0").select(*entry("domain", host, n % 200, True))
        .unionByName(hosts.where("n % 3 = 0 AND n % 2 = 0").select(*entry("domain", host, n % 200 + 30 + n % 50, False)))
        .unionByName(hosts.where("n % 3 = 0 AND n % 7 = 0").select(*entry("domain", host, n % 200 + 120, True)))
        .unionByName(hosts.where("n % 11 = 0 AND locate('.', host) > 0").select(*entry("domain", parent, n % 300, True)))
        .unionByName(paths.where("n % 5 = 0").select(*entry("url", host, n % 250, True)))
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), is_held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_texts(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP4_SQL = r"""
WITH RECURSIVE
doc AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM doc, unnest(range(1, greatest(2, len(w) - 2))) AS r(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
label(doc_id, component_id) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM doc
  UNION
  SELECT near.b, min(l.component_id) FROM label l JOIN near ON near.a = l.doc_id JOIN recurring.label r ON r.doc_id = near.b WHERE l.component_id < r.component_id GROUP BY near.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM label LEFT JOIN size USING (doc_id)
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as fetched on day page_id * 7919 % 400, against the entries of :func:`dated_entries`."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1672531200) + F.col("page_id") * 7919 % 400 * 86400))
    found = url_filter.filter_urls(fetched, dated_entries(pages))
    return found.select(F.col("id").alias("page_id"), "host", F.unix_seconds("fetched_at").alias("fetched_s"), F.size("hits").cast("long").alias("n_hits"), F.array_join("hits", ",").alias("hits"), "blocked")


OP5_SQL = r"""
WITH page AS (
  SELECT page_id, 1672531200 + page_id * 7919 % 400 * 86400 AS t,
         nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)) AS path
  FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM (SELECT DISTINCT host FROM page WHERE host IS NOT NULL)),
p AS (SELECT v, ('0x' || substr(md5(v), 1, 4))::INT AS n FROM (SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]+/[^/]+)', 1) AS v FROM page WHERE host IS NOT NULL AND regexp_matches(path, '^/[^/]+/[^/]+'))),
entry AS (
  SELECT 'domain' AS kind, host AS v, n % 200 AS d, true AS listed FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'domain', host, n % 200 + 30 + n % 50, false FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'domain', host, n % 200 + 120, true FROM h WHERE n % 21 = 0
  UNION ALL SELECT 'domain', substr(host, instr(host, '.') + 1), n % 300, true FROM h WHERE n % 11 = 0 AND instr(host, '.') > 0
  UNION ALL SELECT 'url', v, n % 250, true FROM p WHERE n % 5 = 0),
event AS (SELECT kind, v, 1672531200 + d * 86400 AS ts, bool_and(listed) AS listed FROM entry GROUP BY ALL),
span AS (SELECT *, lead(ts) OVER (PARTITION BY kind, v ORDER BY ts) AS until FROM event),
hit AS (
  SELECT DISTINCT page.page_id, 'rule:' || v AS label FROM page JOIN span ON listed AND ts <= t AND (until IS NULL OR t < until)
   AND ((kind = 'domain' AND (host = v OR ends_with(host, '.' || v)))
     OR (kind = 'url' AND (rtrim(host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/'), '/') = v
                           OR starts_with(host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/'), v || '/')))))
SELECT page.page_id, any_value(host) AS host, any_value(t) AS fetched_s, count(label) AS n_hits,
       coalesce(string_agg(label, ',' ORDER BY label), '') AS hits, count(label) > 0 AS blocked
FROM page LEFT JOIN hit USING (page_id) GROUP BY page.page_id
"""


def span_sum() -> Column:
    """The length of all spans (start, end, ...)."""
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", span_sum().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH doc AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM doc, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN again USING (s), unnest(range(35)) AS t(k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w[j], ' ' ORDER BY j) AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM doc) a ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
"""


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.code_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.hit_digest(found).drop("longest")


OP8_SQL = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
here AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, here.n, item FROM here JOIN win USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", span_sum().alias("n_removed"), F.expr("cast(size(spans) div 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, t[i : i + 99] AS s FROM doc, unnest(range(1, n - 98)) AS r(i)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
step AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM later),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step),
span AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM run GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
kept AS (SELECT doc_id, count(*) AS spans, sum(b - a + 1) AS gone, max(b) AS last, string_agg(hex(t[before + 1 : a - 1]), '' ORDER BY a) AS h FROM cut JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN spans IS NULL THEN sha256(t) ELSE sha256(unhex(h || hex(t[last + 1 : n]))) END AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored()).alias("restored_sha256"))


OP11_SQL = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM doc),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
part AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM part
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def conversations_and_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and conversation -7: a user and an assistant who both say what looks like marks."""
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digest(chat_format.format_conversations(conversations_and_one(spark, sf_dir)))


OP13_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
put AS (
  SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS f FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM put GROUP BY conv_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_line_dedup, op3_toxicity, op4_near_dedup, op5_url_filter, op6_recompression, op7_piece_codec, op8_decontaminate, op9_exact_topk, op10_suffix_dedup,
        op11_fill_middle, op12_whitening, op13_chat_format,
    )
}
ORACLES = {
    "op4_near_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_recompression": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_exact_topk": OP9_SQL, "op10_suffix_dedup": OP10_SQL,
    "op11_fill_middle": OP11_SQL, "op13_chat_format": OP13_SQL,
}
