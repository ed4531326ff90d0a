"""M10 ``extract_posts``: pages to filled post rows, the one operator that
batch, refresh and streaming jobs share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import body, clean, dom, metadata, render
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import drop_table, materialize


def extract_posts(pages: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """M1-M10 with D15-D19: ``page_id, url, author, posted_date, markdown,
    rule``, one row for every row of ``pages(page_id, url, html)``, also where
    ids are null or repeated. ``rule`` tells which body rule matched (0: none;
    ``markdown`` is then the placeholder). Pages are parsed once into a node
    table in the shared folder, under keys of their own. What is small (rows,
    bodies, metadata) is written before the rendering, so that the node table
    and the shuffles that made it go before the rendering's are written."""
    rows, nodes = dom.parse_pages(pages.select("page_id", "url", "html"))
    rows, chosen = materialize(rows), materialize(body.choose_body(nodes))
    meta = materialize(metadata.page_metadata(nodes).withColumnRenamed("page_id", "page_key"))
    md = render.html_to_markdown(clean.drop_noise(clean.scope_nodes(nodes, chosen), profile), profile)
    drop_table(nodes)
    head, _, tail = profile.placeholder_template.partition("{url}")
    placeholder = F.concat(F.lit(head), F.coalesce("url", F.lit("")), F.lit(tail))
    of_page = chosen.select(F.col("page_id").alias("page_key"), F.col("node_id").alias("scope_id"), "rule")
    found = md.withColumnRenamed("page_id", "page_key")  # joined by its own partitioning, so that no Markdown is dealt anew
    return (rows.join(of_page, "page_key", "left").join(meta, "page_key", "left").join(found, ["page_key", "scope_id"], "left")
            .select("page_id", "url", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("posted_date", F.lit("")).alias("posted_date"),
                    F.coalesce("markdown", placeholder).alias("markdown"), F.coalesce("rule", F.lit(0)).cast("bigint").alias("rule")))


def cacheable(posts: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """The posts that go to the cache: those with a body, or all if the
    profile caches placeholders."""
    return posts if profile.cache_placeholders else posts.where("rule > 0")
