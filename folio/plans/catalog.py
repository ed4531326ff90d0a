"""The registered queries (one per SURVEY operator id or job) and their
DuckDB oracle SQL. ``__spark_entry__`` exposes both dicts.

Every query reads the given test tables whole (or data Spark derives from
them). Round-trip ("RT") queries build HTML or Markdown from
``documents`` with a stand-in builder (``folio.plans.standins``), run the
operator on it, and the oracle returns the source columns.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import body, clean, dom
from folio.functions import urls
from folio.plans.sqlkit import html_decode_sql, strip_tags_sql
from folio.session import materialize
from folio.sources.pages import scan_pages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 over the whole ``pages`` table, parsed once into a Parquet node
    table; later scans read only the columns and kinds they need."""
    return materialize(dom.html_nodes(scan_pages(spark, f"{sf_dir}/pages.parquet")))


# --------------------------------------------------------------------------
# Flagship: main-content extraction (S1 -> D1 -> D15 -> D2-D5 -> D6)
# --------------------------------------------------------------------------

def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url")
    nodes = page_nodes(spark, sf_dir)
    chosen = body.find_body(nodes)
    kept = clean.drop_noise(clean.scope_nodes(nodes, chosen))
    text = (kept.where(F.col("kind") == "text")
            .groupBy("page_id")
            .agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY node_id)").alias("body_text")))
    title = (dom.first_match(dom.elements(nodes).where(F.col("tag") == "title")
                             .select("page_id", "node_id", "end_id"))
             .transform(lambda t: dom.node_text(nodes, t, strip=False, out="title"))
             .select("page_id", "title"))
    links = (dom.elements(nodes).where((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
             .groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links")))
    return (pages
            .join(title, "page_id", "left")
            .join(links, "page_id", "left")
            .join(text, "page_id", "left")
            .select("page_id", "url",
                    urls.url_parts("url")["host"].alias("host"),
                    F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("body_text", F.lit("")).alias("body_text"),
                    F.length(F.coalesce("body_text", F.lit(""))).cast("bigint").alias("body_chars")))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"
register("main_content", f"""
SELECT page_id, url,
       lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host,
       {html_decode_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
       CAST(len(regexp_extract_all(html, '<a\\s[^>]*href=', 0)) AS BIGINT) AS n_links,
       {html_decode_sql(strip_tags_sql(_ARTICLE))} AS body_text,
       CAST(length({html_decode_sql(strip_tags_sql(_ARTICLE))}) AS BIGINT) AS body_chars
FROM pages
""")(main_content)


# register the other query groups (they import ``register`` from here)
from folio.plans import q_urls, q_html, q_docs, q_incr  # noqa: E402,F401
