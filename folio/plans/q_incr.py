"""Registered crawl-admission, redirect, cache, refresh and streaming
queries (S2-S5, S7, J1-J3, J5, J6, U3, ST1-ST3).

Crawl records, redirect chains, caches and snapshots are stand-ins made
from every row of ``documents``; the operators do all of their own work
on them.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from folio.operators import incremental, posts
from folio.plans import standins
from folio.plans.catalog import register
from folio.plans.q_html import BODY_MD, POST_URL, _page, ESC, SRC
from folio.profile import DEFAULT_PROFILE as PR
from folio.session import ensure_checkpoint_dir
from folio.sources.pages import table
from folio.streaming import refresh

_ID = "CAST(doc_id AS STRING)"


def _scratch(spark, name: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S2
_S2_PROFILE = dataclasses.replace(PR, max_bytes=20000)
_CT = ("CASE doc_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml'"
       " WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN NULL WHEN 4 THEN 'image/png' ELSE ' TEXT/HTML ' END")
_ST = "CASE doc_id % 9 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 200 END"
# charsets by document: (declared name, Spark body, decoded text in DuckDB); the
# bodies end in bytes that the charset can't hold, or in its own special ones
_HIGH = "regexp_replace(text, '[^ -~]', '?'{g})"
_CHARSETS = [
    ("NULL", "concat(encode(text, 'UTF-8'), X'E2FF')", "text || chr(65533) || chr(65533)"),
    ("'utf8'", "encode(text, 'UTF-8')", "text"),
    ("'US-ASCII'", f"concat(encode({_HIGH.format(g='')}, 'UTF-8'), X'E9')", _HIGH.format(g=", 'g'") + " || chr(65533)"),
    ("'latin-1'", f"concat(encode({_HIGH.format(g='')}, 'UTF-8'), X'E9')", _HIGH.format(g=", 'g'") + " || chr(233)"),
    ("'windows-1252'", f"concat(encode({_HIGH.format(g='')}, 'UTF-8'), X'8096')", _HIGH.format(g=", 'g'") + " || chr(8364) || chr(8211)"),
    ("'gbk'", f"concat(encode({_HIGH.format(g='')}, 'UTF-8'), X'C4E3')", _HIGH.format(g=", 'g'") + " || chr(20320)"),
    ("'UTF-16LE'", "concat(encode(text, 'UTF-16LE'), X'00D8')", "text || chr(65533)"),
    ("'no-such-charset'", "encode(text, 'UTF-8')", "NULL"),
]


def _by_charset(k: int) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(_CHARSETS)) + " END"


_BAD = f"""CASE WHEN {_ST} >= 400 THEN 'HTTP error ' || CAST({_ST} AS VARCHAR)
       WHEN COALESCE({_CT}, '') <> '' AND lower(trim(split_part({_CT}, ';', 1))) NOT IN ('text/html', 'application/xhtml+xml')
            THEN 'Unexpected Content-Type: ' || {_CT} WHEN doc_id % 8 = 7 THEN 'Unknown charset: no-such-charset' END"""


@register("s2_admit_responses", f"""
SELECT url, reject_reason, CASE WHEN reject_reason IS NULL THEN html END AS html
FROM (SELECT {POST_URL} AS url, {_BAD} AS reject_reason, {_by_charset(2)} AS html FROM documents)
""")
def s2_admit_responses(spark, sf):
    """Crawl records (status, content type and a body per document in
    one of eight declared charsets, with bad bytes) admitted or rejected."""
    return incremental.admit_responses(_crawl(spark, sf, _by_charset(0), _by_charset(1))).select("url", "reject_reason", "html")


@register("s2_size_limit", f"""
SELECT {POST_URL} AS url, CASE WHEN {_ST} >= 400 THEN 'HTTP error ' || CAST({_ST} AS VARCHAR)
       WHEN COALESCE({_CT}, '') <> '' AND lower(trim(split_part({_CT}, ';', 1))) NOT IN ('text/html', 'application/xhtml+xml')
            THEN 'Unexpected Content-Type: ' || {_CT}
       WHEN strlen(text) > 20000 THEN 'Response too large: exceeds 20000 bytes' END AS reject_reason FROM documents
""")
def s2_size_limit(spark, sf):
    """S2 with the optional size limit, here 20,000 bytes."""
    return incremental.admit_responses(_crawl(spark, sf, "NULL", "encode(text, 'UTF-8')"), _S2_PROFILE).select("url", "reject_reason")


def _crawl(spark, sf, encoding: str, content: str):
    return table(spark, sf, "documents").select(
        F.expr(POST_URL).alias("url"), F.expr(_ST).cast("int").alias("status"), F.lit(None).cast("string").alias("location"),
        F.expr(_CT).alias("content_type"), F.expr(encoding).cast("string").alias("encoding"), F.expr(content).alias("body"))


# ---------------------------------------------------------------- S3 / J5
_R = f"'{PR.base_url}/r/'"


@register("s3_resolve_redirects", f"""
SELECT {_R} || CAST(doc_id AS VARCHAR) || '/0' AS url,
  CASE WHEN doc_id % 7 >= 5 THEN NULL WHEN doc_id % 13 = 0 AND doc_id % 7 > 0 THEN NULL
       ELSE {_R} || CAST(doc_id AS VARCHAR) || '/' || CAST(doc_id % 7 AS VARCHAR) END AS final_url,
  CAST(least(doc_id % 7, 5) AS INTEGER) AS hops,
  CASE WHEN doc_id % 7 >= 5 THEN 'Exceeded maximum redirects'
       WHEN doc_id % 13 = 0 AND doc_id % 7 > 0 THEN 'Unsafe URL domain: evil.example.com' END AS error
FROM documents
""")
def s3_resolve_redirects(spark, sf):
    """Redirect chains of ``doc_id % 7`` hops (relative
    Location headers; some ending on a foreign domain) followed with
    per-hop validation and a 5-request limit."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("h"))
    steps = docs.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("k"))
    url = F.concat(F.lit(PR.base_url + "/r/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("k").cast("string"))
    loc = (F.when(F.col("k") == F.col("h"), F.lit(None))
           .when((F.col("doc_id") % 13 == 0) & (F.col("k") == F.col("h") - 1),
                 F.concat(F.lit("https://evil.example.com/r/"), F.col("doc_id").cast("string")))
           .otherwise(F.concat(F.lit("/r/"), F.col("doc_id").cast("string"), F.lit("/"), (F.col("k") + 1).cast("string"))))
    crawl = steps.select(url.alias("url"), F.when(F.col("k") == F.col("h"), F.lit(200)).otherwise(F.lit(301)).alias("status"),
                         loc.alias("location"))
    start = docs.select(F.concat(F.lit(PR.base_url + "/r/"), F.col("doc_id").cast("string"), F.lit("/0")).alias("url"))
    return incremental.resolve_redirects(start, crawl).select("url", "final_url", F.col("hops").cast("int").alias("hops"), "error")


@register("s3_long_chains", f"""
WITH d AS (SELECT *, doc_id % 97 AS h FROM documents)
SELECT {_R} || CAST(doc_id AS VARCHAR) || '/0' AS url, CAST(CASE WHEN doc_id % 11 = 0 OR h >= 64 THEN 64 ELSE h END AS INTEGER) AS hops,
  CASE WHEN doc_id % 11 = 0 OR h >= 64 THEN NULL ELSE {_R} || CAST(doc_id AS VARCHAR) || '/' || CAST(h AS VARCHAR) END AS final_url,
  CASE WHEN doc_id % 11 = 0 OR h >= 64 THEN 'Exceeded maximum redirects' END AS error FROM d
""")
def s3_long_chains(spark, sf):
    """Chains of ``doc_id % 97`` hops under a limit of 64 requests;
    every eleventh ends in a loop, and every URL has up to three responses, of
    which the one with the smallest status counts."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 97).cast("int").alias("h"))
    steps = docs.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("k"))
    name = lambda k: F.concat(F.lit(PR.base_url + "/r/"), F.col("doc_id").cast("string"), F.lit("/"), k.cast("string"))
    loops = F.col("doc_id") % 11 == 0
    last = F.col("k") == F.col("h")
    crawl = steps.select(name(F.col("k")).alias("url"), F.when(last & ~loops, 200).otherwise(308).alias("status"),
                         F.when(~last, name(F.col("k") + 1)).when(loops, name(F.floor(F.col("h") / 2))).alias("location"))
    repeats = crawl.unionByName(crawl).unionByName(crawl.withColumn("status", F.lit(503)))
    start = docs.select(name(F.lit(0)).alias("url"))
    return incremental.resolve_redirects(start, repeats, max_requests=64).select("url", "hops", "final_url", "error")


# ---------------------------------------------------------------- cache, S4 S5 S7 J1 J2 J3 U3
_DATE = "CAST(date_add(DATE'2020-01-01', CAST(doc_id % 1000 AS INT)) AS STRING)"
_DATE_DUCK = "CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR)"


def _stubs(spark, sf):
    return table(spark, sf, "documents").select(
        F.expr(POST_URL).alias("url"), F.concat(F.lit("Post "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("section"))


def _cache(spark, sf):
    """Cache of the even documents, written with S5 and read with S4."""
    path = _scratch(spark, "post-cache")
    even = table(spark, sf, "documents").where(F.col("doc_id") % 2 == 0).select(
        F.expr(POST_URL).alias("url"), F.col("text").alias("markdown"), F.col("source").alias("author"),
        F.expr(_DATE).alias("posted_date"))
    incremental.append_post_cache(even, path)
    return incremental.read_post_cache(spark, path)


def _extract_from_documents(spark, sf):
    """extract(stubs): pages for the given stubs are rebuilt from
    documents (meta author, post body) and run through D1, D15-D17, D19
    and M8-M9."""
    html = _page(f"concat('<meta name=\"author\" content=\"', {SRC}, '\">')",
                 f"concat('<div class=\"postBody\"><p>', {ESC}, '</p></div>')")
    pages_all = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.expr(POST_URL).alias("url"), F.expr(html).alias("html"))

    def extract(stubs):
        return posts.extract_posts(pages_all.join(stubs.select("url"), "url", "left_semi"))
    return extract


@register("s7_incremental_posts", f"""
SELECT {POST_URL} AS url, 'Post ' || CAST(doc_id AS VARCHAR) AS title, source AS section,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE {BODY_MD} END AS markdown, source AS author,
  CASE WHEN doc_id % 2 = 0 THEN {_DATE_DUCK} ELSE '' END AS posted_date
FROM documents
""")
def s7_incremental_posts(spark, sf):
    """S7 / U3 with S4, S5, J1-J3: cache-or-compute over all stubs; only
    the stubs missing from the cache are extracted."""
    found, _ = incremental.incremental_posts(_stubs(spark, sf), _cache(spark, sf), _extract_from_documents(spark, sf))
    return found.select("url", "title", "section", "markdown", "author", "posted_date")


register("j1_missing_from_cache", f"SELECT {POST_URL} AS url FROM documents WHERE doc_id % 2 = 1")(
    lambda spark, sf: incremental.missing_from_cache(_stubs(spark, sf), _cache(spark, sf)).select("url"))

register("j2_fill_from_cache", f"""
SELECT {POST_URL} AS url, text AS markdown, source AS author, {_DATE_DUCK} AS posted_date FROM documents WHERE doc_id % 2 = 0
""")(lambda spark, sf: incremental.fill_from_cache(_stubs(spark, sf), _cache(spark, sf))
     .select("url", "markdown", "author", "posted_date"))



def _records(spark, sf, suffix: str = "", where: str = "true"):
    return table(spark, sf, "documents").where(where).select(
        F.expr(POST_URL).alias("url"), F.concat("text", F.lit(suffix)).alias("markdown"), F.col("source").alias("author"), F.expr(_DATE).alias("posted_date"))


@register("s4_read_post_cache", f"""
SELECT sha256({POST_URL}) AS url_key, {POST_URL} AS url, text AS markdown, source AS author, {_DATE_DUCK} AS posted_date FROM documents
""")
def s4_read_post_cache(spark, sf):
    """All documents as cache records, put in with S5 and read back."""
    path = _scratch(spark, "post-cache")
    incremental.append_post_cache(_records(spark, sf), path)
    return incremental.read_post_cache(spark, path)


@register("s5_upsert", f"""
SELECT sha256({POST_URL}) AS url_key, {POST_URL} AS url, text || CASE WHEN doc_id % 5 = 0 THEN ' v3' WHEN doc_id % 3 = 0 THEN ' v2' ELSE '' END AS markdown,
       source AS author, {_DATE_DUCK} AS posted_date FROM documents
""")
def s5_upsert(spark, sf):
    """All documents put in, a third of them again with a newer
    text, compaction, and a fifth once more (some rows twice); a key reads as
    its newest record, from the snapshot or from the log after it."""
    path = _scratch(spark, "post-cache")
    incremental.append_post_cache(_records(spark, sf), path)
    incremental.append_post_cache(_records(spark, sf, " v2", "doc_id % 3 = 0"), path)
    incremental.compact_post_cache(spark, path)
    third = _records(spark, sf, " v3", "doc_id % 5 = 0")
    incremental.append_post_cache(third.unionByName(third), path)
    return incremental.read_post_cache(spark, path)


@register("s4_json", f"""
SELECT 'k' || CAST(doc_id AS VARCHAR) AS url_key, {POST_URL} AS url, text AS markdown, '' AS author, source AS posted_date
FROM documents WHERE doc_id % 4 < 2
""")
def s4_json(spark, sf):
    """A folder of JSON records named by key; every second pair of files
    holds a list or broken JSON instead, which counts as a miss."""
    path = _scratch(spark, "json-cache")
    record = F.to_json(F.struct(F.expr(POST_URL).alias("url"), F.col("text").alias("markdown"), F.col("source").alias("posted_date")))
    value = (F.when(F.col("doc_id") % 4 < 2, record).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("["), record, F.lit("]")))
             .otherwise(F.concat(F.lit("{\"url\": "), F.col("source"))))
    standins.write_files(table(spark, sf, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), value.alias("text")), path, ".json")
    return incremental.read_post_cache(spark, path, "json")


@register("j3_attach_content", f"""
SELECT {POST_URL} AS url, 'Post ' || CAST(doc_id AS VARCHAR) AS title, source AS section,
       {BODY_MD} AS markdown, source AS author, '' AS posted_date FROM documents
""")
def j3_attach_content(spark, sf):
    """Index stubs joined with freshly extracted content by URL."""
    stubs = _stubs(spark, sf)
    return incremental.attach_content(stubs, _extract_from_documents(spark, sf)(stubs))


# ---------------------------------------------------------------- J6 / ST3
@register("j6_snapshot_diff", f"""
SELECT {POST_URL} AS url, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed'
                               WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'same' END AS change FROM documents
""")
def j6_snapshot_diff(spark, sf):
    """J6 / ST3: two snapshots of the corpus (one missing some URLs, the
    other missing others and with some texts revised) compared by URL."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(POST_URL).alias("url"), "text")
    old = d.where(F.col("doc_id") % 10 != 0).select("url", F.col("text").alias("markdown"))
    new = d.where(F.col("doc_id") % 10 != 1).select(
        "url", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit(" (rev)"))).otherwise(F.col("text")).alias("markdown"))
    return refresh.refresh_diff(old, new)


@register("j6_repeated_keys", """
WITH old AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN source ELSE CAST(doc_id AS VARCHAR) END AS url, text FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN source ELSE CAST(doc_id AS VARCHAR) END AS url,
               CASE WHEN doc_id % 50 = 2 THEN NULL ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3 AND NOT (source = 'src1' AND doc_id % 4 = 1)),
o AS (SELECT url, string_agg(coalesce(text, '0x'), '|' ORDER BY coalesce(text, '0x')) AS t FROM old GROUP BY url),
n AS (SELECT url, string_agg(coalesce(text, '0x'), '|' ORDER BY coalesce(text, '0x')) AS t FROM new GROUP BY url)
SELECT CASE WHEN n.t IS NULL THEN o.url ELSE n.url END AS url,
       CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'removed' WHEN o.t <> n.t THEN 'changed' ELSE 'same' END AS change
FROM o FULL JOIN n ON o.url IS NOT DISTINCT FROM n.url
""")
def j6_repeated_keys(spark, sf):
    """J6 with a null key and with keys of many rows (sources): one row for
    each distinct key, compared by all of its rows."""
    key = F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN source ELSE CAST(doc_id AS STRING) END").alias("url")
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 0").select(key, F.col("text").alias("markdown"))
    new = d.where("doc_id % 10 <> 3 AND NOT (source = 'src1' AND doc_id % 4 = 1)").select(key, F.when(F.col("doc_id") % 50 != 2, F.col("text")).alias("markdown"))
    return incremental.snapshot_diff(old, new)


# ---------------------------------------------------------------- ST1 / ST2
@register("st1_stream_new_pages", f"SELECT {POST_URL} AS url, {BODY_MD} AS markdown FROM documents WHERE doc_id % 7 <> 6")
def st1_stream_new_pages(spark, sf):
    """ST1 / ST2: page files (documents rebuilt as pages, in two files,
    some URLs repeated) streamed with availableNow into the cache; the
    same files replayed under a fresh checkpoint add nothing. The cache
    is returned."""
    root = _scratch(spark, "stream")
    html = _page("''", f"CASE WHEN doc_id % 7 = 6 THEN concat('<p>', {ESC}, '</p>') ELSE concat('<div class=\"postBody\"><p>', {ESC}, '</p></div>') END")
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.expr(POST_URL).alias("url"),
                                                F.expr(html).alias("html"))
    pages.where(F.col("page_id") % 2 == 0).write.parquet(root + "/in/a")
    # a later record of a URL has another text; the first one counts
    later = pages.withColumns({"page_id": F.col("page_id") + (1 << 40), "html": F.replace("html", F.lit("<p>"), F.lit("<p>later "))})
    pages.where(F.col("page_id") % 2 == 1).unionByName(later.where(F.col("page_id") % 5 == 0)).write.parquet(root + "/in/b")

    def extract(p):
        return posts.cacheable(posts.extract_posts(p))

    for run in ("c1", "c2"):
        refresh.stream_new_pages(spark, root + "/in/*", root + "/cache", root + "/" + run, extract)
    return incremental.read_post_cache(spark, root + "/cache").select("url", "markdown")


@register("st2_stream_dedup", "SELECT source AS url, min(doc_id) AS page_id, arg_min(text, doc_id) AS html FROM documents GROUP BY source")
def st2_stream_dedup(spark, sf):
    """ST2: the first record of each key in a batch; keys are sources here,
    so a hot key is there."""
    batch = table(spark, sf, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    return refresh.stream_dedup(batch)


@register("st2_stream_state", """
SELECT url, arg_min(doc_id, doc_id % 3 * 1000000000000 + doc_id) AS page_id, arg_min(text, doc_id % 3 * 1000000000000 + doc_id) AS html
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN source ELSE substr(md5(text), 1, 3) END AS url FROM documents) GROUP BY url
""")
def st2_stream_state(spark, sf):
    """ST2 over three batches that share keys, some of them hot: all documents,
    dealt to the batches by ``doc_id``; keyed state holds what earlier ones had."""
    root = _scratch(spark, "state")
    pages = table(spark, sf, "documents").select(F.expr("CASE WHEN doc_id % 4 = 0 THEN source ELSE substr(md5(text), 1, 3) END").alias("url"),
                                                F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    for k in range(3):  # one file a batch, the next one is written when the last one is read
        pages.where(F.col("page_id") % 3 == k).write.parquet(f"{root}/in/{k}")
        arrived = spark.readStream.schema(pages.schema).parquet(root + "/in/*")
        (refresh.dedup_stream(arrived).writeStream.format("parquet").option("checkpointLocation", root + "/run").option("path", root + "/out")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(pages.schema).parquet(root + "/out")
