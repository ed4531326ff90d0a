"""Page metadata: author and publication date.

Each strategy yields candidate rows ``(page_id, rank..., value)``; the
chain "first strategy with a non-empty result" is a top-1 per page over
the non-empty candidates, so all strategies run in one pass over the
(small) filtered node sets instead of one document walk per strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import clean_author, iso_date_prefix
from folio.operators.dom import elements, py_strip
from folio.profile import DEFAULT_PROFILE, SiteProfile


def _scope_rank(nodes: DataFrame) -> DataFrame:
    """Per page: the head and body intervals (NULL when absent)."""
    el = elements(nodes).where(F.col("tag").isin("head", "body"))
    return (el.groupBy("page_id").agg(
        F.min(F.when(F.col("tag") == "head", F.col("node_id"))).alias("_hs"),
        F.min_by(F.when(F.col("tag") == "head", F.col("end_id")),
                 F.when(F.col("tag") == "head", F.col("node_id"))).alias("_he"),
        F.min(F.when(F.col("tag") == "body", F.col("node_id"))).alias("_bs"),
        F.min_by(F.when(F.col("tag") == "body", F.col("end_id")),
                 F.when(F.col("tag") == "body", F.col("node_id"))).alias("_be")))


def _in(lo: str, hi: str) -> Column:
    return F.col(lo).isNotNull() & (F.col("node_id") > F.col(lo)) & (F.col("node_id") <= F.col(hi))


def jsonld_scripts(nodes: DataFrame) -> DataFrame:
    """M1: ``script[type=application/ld+json]`` with their raw text and a
    scope rank (0 = head, 1 = body; the whole document is scope 0 when
    there is no head). Empty scripts are skipped."""
    scripts = elements(nodes).where((F.col("tag") == "script")
                                    & (F.col("attrs").getItem("type") == "application/ld+json"))
    raw = nodes.where(F.col("kind") == "raw").select("page_id", F.col("parent_id").alias("node_id"),
                                                      F.col("text").alias("json"))
    s = (scripts.select("page_id", "node_id").join(raw, ["page_id", "node_id"], "inner")
         .join(_scope_rank(nodes), "page_id", "left"))
    scope = (F.when(F.col("_hs").isNull(), F.lit(0))
             .when(_in("_hs", "_he"), F.lit(0))
             .when(_in("_bs", "_be"), F.lit(1)))
    return (s.withColumn("scope", scope).where(F.col("scope").isNotNull() & (F.col("json") != ""))
            .select("page_id", "node_id", "scope", "json"))


def parse_jsonld(scripts: DataFrame) -> DataFrame:
    """M2-M4: per page the first non-empty JSON-LD author and date.

    Cheap text pre-tests first; invalid JSON or a non-object is ignored.
    Author: object -> its non-empty ``name``; non-empty string -> itself;
    lists and other types -> none. Date: ``datePublished`` then
    ``dateCreated``, first 10 characters."""
    v = F.try_parse_json(F.col("json"))
    s = scripts.withColumn("_v", v).where(F.col("_v").isNotNull()
                                          & F.schema_of_variant("_v").startswith("OBJECT"))
    a = F.try_variant_get(F.col("_v"), "$.author", "variant")
    a_type = F.schema_of_variant(a)
    author = (F.when(~F.col("json").contains('"author"'), F.lit(None))
              .when(a_type.startswith("OBJECT"), F.try_variant_get(F.col("_v"), "$.author.name", "string"))
              .when(a_type == "STRING", F.try_variant_get(F.col("_v"), "$.author", "string")))
    has_date = F.col("json").contains('"datePublished"') | F.col("json").contains('"dateCreated"')
    dp = F.nullif(F.try_variant_get(F.col("_v"), "$.datePublished", "string"), F.lit(""))
    dc = F.nullif(F.try_variant_get(F.col("_v"), "$.dateCreated", "string"), F.lit(""))
    date = F.when(has_date, iso_date_prefix(F.coalesce(dp, dc)))
    order = F.struct("scope", "node_id")
    return (s.select("page_id", "scope", "node_id", F.nullif(author, F.lit("")).alias("a"),
                     F.nullif(date, F.lit("")).alias("d"))
            .groupBy("page_id")
            .agg(F.min_by("a", F.when(F.col("a").isNotNull(), order)).alias("author_ld"),
                 F.min_by("d", F.when(F.col("d").isNotNull(), order)).alias("date_ld")))


def author_meta(nodes: DataFrame) -> DataFrame:
    """M5: first ``meta[name=author]`` in the head, else in the whole
    document; its trimmed ``content`` when that is non-empty."""
    metas = (elements(nodes).where((F.col("tag") == "meta") & (F.col("attrs").getItem("name") == "author"))
             .join(_scope_rank(nodes), "page_id", "left")
             .withColumn("_head", F.when(_in("_hs", "_he"), F.lit(0)).otherwise(F.lit(1))))
    w = Window.partitionBy("page_id").orderBy("_head", "node_id")
    first = metas.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    content = F.col("attrs").getItem("content")
    return first.select("page_id", F.when(F.coalesce(content, F.lit("")) != "", py_strip(content))
                        .alias("author_meta"))


def author_byline(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """M6: the first ``a``/``span`` whose class matches the byline pattern;
    its stripped text (only the first element is tried)."""
    cand = elements(nodes).where(F.col("tag").isin("a", "span")
                                 & F.coalesce(F.exists("classes", lambda c: c.rlike(profile.byline_class_regex)),
                                              F.lit(False)))
    w = Window.partitionBy("page_id").orderBy("node_id")
    first = cand.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("page_id", "node_id", "end_id")
    texts = nodes.where(F.col("kind") == "text").select("page_id", F.col("node_id").alias("_t"),
                                                        py_strip(F.col("text")).alias("_x"))
    joined = (first.join(texts, "page_id").where((F.col("_t") > F.col("node_id")) & (F.col("_t") <= F.col("end_id")))
              .groupBy("page_id").agg(F.expr("listagg(_x, '') WITHIN GROUP (ORDER BY _t)").alias("author_byline")))
    return first.select("page_id").join(joined, "page_id", "left")


def extract_author(nodes: DataFrame, jsonld: DataFrame | None = None,
                   profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """M8: JSON-LD -> meta -> byline, then M7 clean-up; ``''`` if none."""
    ld = jsonld if jsonld is not None else parse_jsonld(jsonld_scripts(nodes))
    pages = nodes.select("page_id").distinct()
    j = (pages.join(ld.select("page_id", "author_ld"), "page_id", "left")
         .join(author_meta(nodes), "page_id", "left")
         .join(author_byline(nodes, profile), "page_id", "left"))
    first = F.coalesce(F.nullif(F.col("author_ld"), F.lit("")), F.nullif(F.col("author_meta"), F.lit("")),
                       F.nullif(F.col("author_byline"), F.lit("")), F.lit(""))
    return j.select("page_id", clean_author(first).alias("author"))


# ---- fixed values: meta keys tried for the publication date, in order ----
DATE_META_KEYS = ("article:published_time", "datePublished", "date")


def posted_date(nodes: DataFrame, jsonld: DataFrame | None = None) -> DataFrame:
    """M9: JSON-LD date -> meta keys in order (``property`` before
    ``name``, head before the rest of the document) -> first
    ``time[datetime]``; 10 characters. Whitespace-only meta content is
    skipped (documented fix of the original quirk)."""
    ld = jsonld if jsonld is not None else parse_jsonld(jsonld_scripts(nodes))
    attrs = F.col("attrs")
    metas = (elements(nodes).where(F.col("tag") == "meta")
             .join(_scope_rank(nodes), "page_id", "left")
             .withColumn("_scope", F.when(F.col("_hs").isNull() | _in("_hs", "_he"), F.lit(0)).otherwise(F.lit(1))))
    cands = []
    for i, key in enumerate(DATE_META_KEYS):
        for j, an in enumerate(("property", "name")):
            cands.append(metas.where(attrs.getItem(an) == key).select(
                "page_id", F.col("_scope").alias("r1"), F.lit(i * 2 + j).alias("r2"), F.col("node_id").alias("r3"),
                iso_date_prefix(py_strip(attrs.getItem("content"))).alias("v")))
    cand = cands[0]
    for c in cands[1:]:
        cand = cand.unionByName(c)
    meta_date = (cand.where(F.coalesce(F.col("v"), F.lit("")) != "")
                 .groupBy("page_id").agg(F.min_by("v", F.struct("r1", "r2", "r3")).alias("date_meta")))
    times = (elements(nodes).where((F.col("tag") == "time") & attrs.getItem("datetime").isNotNull())
             .groupBy("page_id").agg(F.min_by(iso_date_prefix(attrs.getItem("datetime")), F.col("node_id"))
                                     .alias("date_time")))
    pages = nodes.select("page_id").distinct()
    j = (pages.join(ld.select("page_id", "date_ld"), "page_id", "left")
         .join(meta_date, "page_id", "left").join(times, "page_id", "left"))
    return j.select("page_id", F.coalesce(F.nullif(F.col("date_ld"), F.lit("")), F.col("date_meta"),
                                          F.col("date_time"), F.lit("")).alias("posted_date"))


def page_metadata(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """M8 + M9 with the JSON-LD scripts parsed once for both fields."""
    ld = parse_jsonld(jsonld_scripts(nodes))
    return extract_author(nodes, ld, profile).join(posted_date(nodes, ld), "page_id", "full")
