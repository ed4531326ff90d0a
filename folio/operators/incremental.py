"""Crawl admission, redirects, the post cache and incremental refresh
(S2-S5, S7, J1-J3, J6).

The cache is a versioned parquet table keyed by ``url_key`` (S6); a refresh
processes only stubs whose key is absent (anti-join), extracts them, and
puts the new records in. A snapshot diff compares digest trees and joins only
the key buckets that differ.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio import schemas
from folio.functions import urls
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import materialize
from folio.sources import files

# ---- fixed values: names of the charsets that built-in functions decode ----
UTF8 = ("utf-8", "utf8")
LATIN1 = ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "l1", "8859", "cp819")
ASCII = ("us-ascii", "ascii", "646")
CP1252 = ("windows-1252", "cp1252", "1252")
# ---- fixed values: characters of windows-1252 at 0x80-0x9F (five are undefined) ----
CP1252_HIGH = "\u20ac\ufffd\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\ufffd\u017d\ufffd" \
              "\ufffd\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\ufffd\u017e\u0178"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("known", T.BooleanType())]))
def _decode_other(body: pd.Series, charset: pd.Series) -> pd.DataFrame:
    def one(b, c):
        try:
            return (None if b is None else bytes(b).decode(c, "replace")), True
        except (LookupError, ValueError):
            return None, False
    return pd.DataFrame([one(b, c) for b, c in zip(body, charset)], columns=["text", "known"])


def decode_bodies(crawl: DataFrame, out: str = "html") -> DataFrame:
    """``out`` = the body by its declared charset (UTF-8 if none), invalid
    bytes replaced; ``charset_known`` is false for a name that nothing
    decodes. Common charsets stay in the JVM; only rows of other ones reach
    Python's codecs."""
    cs = F.lower(F.coalesce(F.nullif(F.trim(F.col("encoding")), F.lit("")), F.lit("utf-8")))
    tagged = crawl.withColumn("_cs", F.replace(cs, F.lit("_"), F.lit("-")))
    c, latin = F.col("_cs"), F.expr("decode(body, 'ISO-8859-1')")
    controls = "".join(chr(x) for x in range(0x80, 0xA0))
    native = (F.when(c.isin(*LATIN1), latin)
              .when(c.isin(*ASCII), F.regexp_replace(latin, "[\\x80-\\xff]", "\ufffd"))
              .when(c.isin(*CP1252), F.translate(latin, controls, CP1252_HIGH))
              .otherwise(F.expr("make_valid_utf8(cast(body AS STRING))")))
    inside = c.isin(*UTF8, *LATIN1, *ASCII, *CP1252)
    own = tagged.where(inside).withColumns({out: native, "charset_known": F.lit(True)})
    other = (tagged.where(~inside).withColumn("_d", _decode_other("body", "_cs"))
             .withColumns({out: F.col("_d.text"), "charset_known": F.col("_d.known")}).drop("_d"))
    return own.unionByName(other).drop("_cs")


# ---- fixed values: messages of rejected responses ----
HTTP_ERROR, BAD_TYPE, TOO_LARGE = "HTTP error ", "Unexpected Content-Type: ", "Response too large: exceeds {} bytes"


def admit_responses(crawl: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Keep a record when its status is not an error, its MIME type
    (before ``;``, trimmed, lower-cased) is allowed or absent, its charset is
    known and, if the profile sets ``max_bytes``, its body is no larger; decode
    the body. Rejected rows keep a ``reject_reason`` and a NULL ``html``."""
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    mime = F.lower(F.trim(F.split_part(ct, F.lit(";"), F.lit(1))))
    reason = (F.when(F.col("status") >= 400, F.concat(F.lit(HTTP_ERROR), F.col("status").cast("string")))
              .when((ct != "") & ~mime.isin(list(profile.mime_allow)), F.concat(F.lit(BAD_TYPE), F.col("content_type"))))
    if profile.max_bytes is not None:
        reason = reason.when(F.length("body") > profile.max_bytes, F.lit(TOO_LARGE.format(profile.max_bytes)))
    reason = reason.when(~F.col("charset_known"), F.concat(F.lit("Unknown charset: "), F.col("encoding")))
    decoded = decode_bodies(crawl, "_html").withColumn("reject_reason", reason)
    return (decoded.withColumn("html", F.when(F.col("reject_reason").isNull(), F.col("_html")))
            .select(*crawl.columns, "reject_reason", "html"))


def _responses(crawl: DataFrame) -> DataFrame:
    """One response per URL: the one with the smallest status, then the
    smallest location. Rows without a URL answer nothing."""
    return (crawl.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("status", F.coalesce("location", F.lit("")).alias("location"))).alias("_r"))
            .select("url", F.col("_r.status").alias("status"), F.col("_r.location").alias("location")))


def resolve_redirects(start: DataFrame, crawl: DataFrame, profile: SiteProfile = DEFAULT_PROFILE,
                      max_requests: int | None = None) -> DataFrame:
    """Follow ``Location`` chains from ``start(url)`` through the
    ``crawl`` table: each hop's URL is validated (P3), a relative target is
    resolved against the current URL, a redirect without ``Location`` is a final
    response, and at most ``max_requests`` requests are made (so ``max_requests
    - 1`` redirects; a loop ends there too). A URL with several responses counts
    as ``_responses`` says. Returns ``url, final_url, last_url, hops, error``, one
    row for each row of ``start``; ``last_url`` is the last one reached, also
    after an error.

    The crawl's redirects are a relation of single hops, made once. Joined with
    itself it becomes the relation of 2, 4, 8, ... hops, each written once; a
    chain is walked by the bits of ``max_requests``, so a limit of 1,000 takes
    10 doublings and a plan of no more joins than a limit of 5."""
    n = max_requests or profile.max_requests
    resp = materialize(_responses(crawl))
    hop = (resp.where(F.col("status").isin(list(profile.redirect_statuses)) & (F.col("location") != ""))
           .select(F.col("url").alias("_from"), urls.resolve_url("location", "url").alias("_to")).withColumn("_v", urls.validate_url("_to", profile))
           .select("_from", F.when(F.col("_v.error").isNull(), F.col("_v.url")).otherwise(F.col("_to")).alias("_to"),
                   F.lit(1).alias("_n"), F.col("_v.error").alias("_error")))
    first = start.select("url").withColumn("_v", urls.validate_url("url", profile))
    cur = first.select("url", F.coalesce("_v.url", "url").alias("_cur"), F.lit(0).alias("hops"), F.col("_v.error").alias("error"))
    for bit in range(n.bit_length()):
        hop = materialize(hop)
        if n >> bit & 1:
            go = (F.col("_cur") == F.col("_from")) & F.col("error").isNull()
            cur = cur.join(hop, go, "left").select("url", F.coalesce("_to", "_cur").alias("_cur"), (F.col("hops") + F.coalesce("_n", F.lit(0))).alias("hops"),
                                                   F.coalesce("error", "_error").alias("error"))
        if n >> bit > 1:
            far = hop.select(*[F.col(c).alias("_far" + c) for c in hop.columns])
            hop = (hop.join(far, (F.col("_to") == F.col("_far_from")) & F.col("_error").isNull(), "left")
                   .select("_from", F.coalesce("_far_to", "_to").alias("_to"), (F.col("_n") + F.coalesce("_far_n", F.lit(0))).alias("_n"),
                           F.coalesce("_error", "_far_error").alias("_error")))
    cur = cur.join(resp.select(F.col("url").alias("_cur"), F.col("status").alias("_st")), "_cur", "left")
    over = F.col("hops") >= n
    error = (F.when(over, F.lit("Exceeded maximum redirects")).when(F.col("error").isNotNull(), F.col("error"))
             .when(F.col("_st").isNull(), F.lit("No response")))
    return cur.select("url", F.when(error.isNull(), F.col("_cur")).alias("final_url"), F.col("_cur").alias("last_url"), "hops", error.alias("error"))


#: Fields of a cache record beside its key, and the hex digits of the key that name its bucket (256 of them).
CACHE_FIELDS, BUCKET_DIGITS = ("url", "markdown", "author", "posted_date"), 2


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(version of the current snapshot or 0, versions of the appends after it)."""
    fs, root = _fs(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = {kind: [int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(new(root, f"{kind}/version=*")) or []] for kind in ("log", "current")}
    now = max(found["current"], default=0)  # a pointer is an empty file named by its version, made after the snapshot is whole
    return now, sorted(v for v in found["log"] if v > now and fs.exists(new(root, f"log/version={v}/_SUCCESS")))


def _bucket() -> F.Column:
    return F.substring("url_key", 1, BUCKET_DIGITS).alias("bucket")


def one_per_key(records: DataFrame, version: F.Column | None = None) -> DataFrame:
    """The newest record of each ``url_key``: the highest ``version``, then the
    greatest fields, so that a result never depends on row order."""
    order = F.struct(*([version.alias("_version")] if version is not None else []), *[F.col(c) for c in ("posted_date", "author", "markdown", "url")])
    return records.groupBy("url_key").agg(F.max(order).alias("_r")).select("url_key", *[F.col("_r")[c].alias(c) for c in CACHE_FIELDS])


def read_post_cache(spark: SparkSession, path: str, fmt: str = "parquet", key_pattern: str = "([^/]*?)(?:\\.json)?$",
                    keys: DataFrame | None = None) -> DataFrame:
    """The cache, one record per key; missing fields read as ``''``.

    The table is a snapshot and the appends since (S5). Only keys that an append
    has are reduced to their newest record; the snapshot's other rows are read as
    they are. With ``keys(url_key)`` only the buckets of those keys are read (their
    names, 256 at most, go to the scan as a partition filter).

    ``fmt='json'`` imports one-record-per-file JSON, of a folder with all below
    it or of a pattern (a folder is listed and read in tasks): the key is taken from the
    file's path by ``key_pattern`` (by default its name); a corrupt record, a list
    or another non-object is a miss (dropped), an empty object a record without
    fields. Of several files of a key the greatest record counts."""
    if fmt == "json":
        found = files.read_whole(spark, path).withColumnRenamed("path", "_file")
        rec = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
        df = (found.where(F.ltrim("value").startswith("{")).withColumn("_r", rec).where("_r IS NOT NULL")
              .where((F.size("_r") > 0) | F.col("value").rlike("^\\s*\\{\\s*\\}\\s*$"))
              .select(F.regexp_extract("_file", key_pattern, 1).alias("url_key"), F.col("_r")["url"].alias("url"),
                      *[F.coalesce(F.col("_r")[c], F.lit("")).alias(c) for c in ("markdown", "author", "posted_date")]))
        return one_per_key(df)
    now, log = _versions(spark, path)
    schema = T.StructType([*schemas.POST_CACHE.fields, T.StructField("bucket", T.StringType())])
    wanted = None if keys is None else [r[0] for r in keys.select(_bucket()).distinct().collect()]

    def part(*folders: str) -> DataFrame:
        found = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
        found = found if wanted is None else found.where(F.col("bucket").isin(wanted))
        fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("markdown", "author", "posted_date")]
        return found.select("url_key", "url", *fields)

    old = part(f"snapshot/version={now}") if now else None
    if not log:
        return old if old is not None else spark.createDataFrame([], schemas.POST_CACHE).select("url_key", *CACHE_FIELDS)
    versions = [part(f"log/version={v}").withColumn("_v", F.lit(v)) for v in log]
    new = versions[0]
    for more in versions[1:]:
        new = new.unionByName(more)
    new = one_per_key(new, F.col("_v"))
    return new if old is None else new.unionByName(old.join(new.select("url_key"), "url_key", "left_anti"))


def has_cache(spark: SparkSession, path: str) -> bool:
    """Whether the cache folder exists (asked of its own file system)."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def append_post_cache(records: DataFrame, path: str, compact_after: int = 16) -> None:
    """Put extracted records (markdown, author, date -- title and section
    come from the index) into the cache; a key's record replaces its earlier one.
    Each call is one more version of the log, partitioned by key prefix; after
    ``compact_after`` versions the cache is compacted. Records without a URL have
    no key and are left out. Write errors fail the job. One writer at a time."""
    spark = records.sparkSession
    now, log = _versions(spark, path)
    keyed = records.where("url IS NOT NULL").select(urls.url_key("url").alias("url_key"), *CACHE_FIELDS)
    version = max([now, *log]) + 1
    # an append that failed half-way has no _SUCCESS file; its folder is written anew
    _write_buckets(keyed, f"{path}/log/version={version}")
    if len(log) + 1 >= compact_after:
        compact_post_cache(spark, path)


def _write_buckets(records: DataFrame, path: str) -> None:
    """Write records by bucket: each bucket is as many files as it takes to use
    all shuffle partitions, so the number of files doesn't grow with the tasks
    that made the records."""
    digits = 16 ** BUCKET_DIGITS
    parts = -(-int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) // digits)
    (records.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("url_key"), F.lit(parts)))
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def compact_post_cache(spark: SparkSession, path: str) -> None:
    """Write the cache's newest records as a snapshot and then point to it.
    Readers see the old snapshot and its log until the pointer is there."""
    now, log = _versions(spark, path)
    if not log:
        return
    version = log[-1]
    _write_buckets(read_post_cache(spark, path), f"{path}/snapshot/version={version}")
    fs, root = _fs(spark, path)
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"current/version={version}"), True).close()


def missing_from_cache(stubs: DataFrame, cache: DataFrame) -> DataFrame:
    """Stubs without a cache record (anti-join on the URL key)."""
    return stubs.withColumn("url_key", urls.url_key("url")).join(cache.select("url_key"), "url_key", "left_anti")


def fill_from_cache(stubs: DataFrame, cache: DataFrame) -> DataFrame:
    """Stubs with a record, filled from it: one row for each such stub, as
    the wanted records are first reduced to one per key (``one_per_key``)."""
    keyed = stubs.withColumn("url_key", urls.url_key("url"))
    wanted = cache.join(keyed.select("url_key").distinct(), "url_key", "left_semi").select("url_key", *CACHE_FIELDS)
    return keyed.join(one_per_key(wanted).drop("url"), "url_key", "inner")


def attach_content(stubs: DataFrame, extracted: DataFrame) -> DataFrame:
    """title/section from the index, content from the page (left join on
    URL); missing content reads as ``''``. Of several contents of a URL the
    greatest (date, author, text) counts; each stub gives one row."""
    fields = ("posted_date", "author", "markdown")
    e = (extracted.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])).alias("_e")))
    j = stubs.join(e, "url", "left")
    return j.select(*stubs.columns, *[F.coalesce(F.col("_e")[c], F.lit("")).alias(c) for c in ("markdown", "author", "posted_date")])


def incremental_posts(stubs: DataFrame, cache: DataFrame, extract, profile: SiteProfile = DEFAULT_PROFILE) -> tuple[DataFrame, DataFrame]:
    """Cache-or-compute. Hits are filled from the cache and never
    re-extracted; misses go through ``extract(missing_stubs) -> url,
    markdown, author, posted_date``. Returns ``(posts, new_cache_rows)``;
    the caller appends the new rows (S5). Rows without a body (``rule`` 0) are
    not cached unless the profile says so."""
    hits = fill_from_cache(stubs, cache).drop("url_key")
    miss = missing_from_cache(stubs, cache).drop("url_key")
    made = materialize(extract(miss))  # read by both results, extracted once
    fresh = attach_content(miss, made)
    posts = hits.select(*fresh.columns).unionByName(fresh)
    new = made if profile.cache_placeholders or "rule" not in made.columns else made.where("rule > 0")
    return posts, new.select("url", "markdown", "author", "posted_date")


#: Leaves of the digest tree, and leaves below one node of its upper level.
LEAVES, FAN = 1 << 16, 256


def snapshot_digest(snapshot: DataFrame, key: str = "url", value: str = "markdown") -> DataFrame:
    """Leaves of a snapshot's digest tree: ``leaf, rows, x, total``, one row for
    each of ``LEAVES`` key buckets that has rows. A row counts with two hashes of
    its key and text, one XOR-ed and one summed, so tasks combine their rows
    before the shuffle and repeated rows count too. A day's digest can be kept
    and handed to the next day's ``snapshot_diff``."""
    return (snapshot.select(_leaf(key).alias("leaf"), _row_hash(1, key, value).alias("a"), _row_hash(2, key, value).cast("decimal(38,0)").alias("b"))
            .groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("a").alias("x"), F.sum("b").alias("total")))


def _row_hash(seed: int, *names: str) -> F.Column:
    """64 bits of the values; a null differs from every value."""
    return F.xxhash64(F.lit(seed), *[x for c in names for x in (F.col(c).isNull(), F.col(c))])


def _leaf(key: str) -> F.Column:
    return F.pmod(_row_hash(0, key), F.lit(LEAVES)).cast("int")


def changed_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves in which two digests differ. Nodes of the upper level (sums of
    ``FAN`` leaves) are compared first, then the leaves of those that differ."""
    sums = ("rows", "x", "total")

    def differ(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        b = b.select(by, *[F.col(c).alias("_" + c) for c in sums])
        same = F.lit(True)
        for c in sums:
            same &= F.col(c).eqNullSafe(F.col("_" + c))
        return a.join(b, by, "full").where(~same).select(by)

    def upper(d: DataFrame) -> DataFrame:
        return d.groupBy(F.floor(F.col("leaf") / FAN).cast("int").alias("node")).agg(F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.sum("total").alias("total"))

    nodes = differ(upper(old), upper(new), "node")
    below = lambda d: d.withColumn("node", F.floor(F.col("leaf") / FAN).cast("int")).join(F.broadcast(nodes), "node", "left_semi")
    return differ(below(old), below(new), "leaf")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "url", value: str = "markdown", same: bool = True,
                  old_digest: DataFrame | None = None) -> DataFrame:
    """J6 / ST3: ``key, change`` in added / removed / changed / same, one row
    for each distinct key; a null key is a key. A key that repeats is ``same`` if
    both sides have the same rows of it, as often. Texts are compared by 128 bits.

    Digest trees of both sides tell which buckets of keys differ; only rows of
    those are shuffled and joined. Of the other buckets only the keys are read
    again, and with ``same=False`` (no ``same`` rows) nothing."""
    before = materialize(snapshot_digest(old, key, value) if old_digest is None else old_digest)
    after = materialize(snapshot_digest(new, key, value))
    leaves = F.broadcast(materialize(changed_leaves(before, after)))  # LEAVES numbers at most

    def digests(side: DataFrame, tag: str) -> DataFrame:
        rows = side.select(key, value).withColumn("leaf", _leaf(key)).join(leaves, "leaf", "left_semi")
        return (rows.groupBy(key).agg(F.struct(F.count(F.lit(1)), F.bit_xor(_row_hash(1, value)), F.sum(_row_hash(2, value).cast("decimal(38,0)"))).alias(tag))
                .withColumnRenamed(key, "_key" + tag))

    j = digests(old, "_ho").join(digests(new, "_hn"), F.col("_key_ho").eqNullSafe(F.col("_key_hn")), "full")
    change = (F.when(F.col("_ho").isNull(), F.lit("added")).when(F.col("_hn").isNull(), F.lit("removed"))
              .when(F.col("_ho") != F.col("_hn"), F.lit("changed")).otherwise(F.lit("same")))
    out = j.select(F.when(F.col("_hn").isNull(), F.col("_key_ho")).otherwise(F.col("_key_hn")).alias(key), change.alias("change"))
    if not same:
        return out.where("change != 'same'")
    rest = new.select(key).withColumn("leaf", _leaf(key)).join(leaves, "leaf", "left_anti").select(key).distinct()
    return out.unionByName(rest.withColumn("change", F.lit("same")))
