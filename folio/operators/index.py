"""Corpus index: index pages -> ordered, sectioned, de-duplicated post
stubs (D14, I1-I4, S8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import urls
from folio.operators.dom import descendants_of, elements, has_class_token, node_text
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import materialize


def is_main_content(classes: str = "classes") -> Column:
    """A class token containing ``content`` and none containing
    ``tableofcontents`` (both case-insensitive)."""
    c = F.col(classes)
    return (F.coalesce(F.exists(c, lambda t: F.lower(t).contains("content")), F.lit(False))
            & ~F.coalesce(F.exists(c, lambda t: F.lower(t).contains("tableofcontents")), F.lit(False)))


def locate_index_content(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Per page the first main-content ``div`` (P12) -> first
    ``main`` -> first ``article`` -> ``body``; the ``body`` whenever a
    grouped-item div exists anywhere. Pages with no candidate are absent.
    Returns ``page_id, node_id, end_id``."""
    tag = F.col("tag")
    rank = (F.when((tag == "div") & is_main_content(), F.lit(1)).when(tag == "main", F.lit(2))
            .when(tag == "article", F.lit(3)).when(tag == "body", F.lit(4)))
    group = (tag == "div") & has_class_token(profile.group_item_class, "contains") & F.col("page_id").isNotNull()
    # an element's rank and place in one number, so that a page is a row of a few numbers before any shuffle
    own = (nodes.where((F.col("kind") == "element") & tag.isin("div", "main", "article", "body"))
           .select("page_id", "end_id", (rank.cast("long") * (1 << 32) + F.col("node_id")).alias("_at"), (rank == 4).alias("_body"), group.alias("_group"))
           .where("_at IS NOT NULL OR _group"))
    body = F.when(F.col("_body"), F.col("_at"))
    page = own.groupBy("page_id").agg(
        F.max("_group").alias("_grouped"), F.min("_at").alias("_at"), F.min_by("end_id", "_at").alias("_end"),
        F.min(body).alias("_at_body"), F.min_by("end_id", body).alias("_end_body"))
    pick = lambda grouped, other: F.when(F.col("_grouped"), F.col(grouped)).otherwise(F.col(other))
    return (page.select("page_id", pick("_at_body", "_at").alias("_at"), pick("_end_body", "_end").alias("end_id")).where("_at IS NOT NULL")
            .select("page_id", F.col("_at").bitwiseAND((1 << 32) - 1).cast("int").alias("node_id"), "end_id"))


def _links_in(nodes: DataFrame, containers: DataFrame, profile: SiteProfile) -> DataFrame:
    """Anchors inside ``containers(page_id, node_id, end_id, ...)``,
    carrying ``anc_*`` container columns, with stripped text, resolved
    URL and the P13 keep-test applied."""
    anchors = elements(nodes).where(F.col("tag") == "a").select(
        "page_id", "node_id", "end_id", F.col("attrs").getItem("href").alias("href"))
    inside = descendants_of(anchors, containers, "inner", include_self=False)
    title = node_text(nodes, inside.select("page_id", "node_id", "end_id").distinct(), out="title").drop("end_id")
    out = (inside.join(title, ["page_id", "node_id"], "left")
           .withColumn("title", F.coalesce(F.col("title"), F.lit("")))
           .where(F.coalesce(F.col("href"), F.lit("")) != ""))
    out = urls.classify_links_df(out, "href", profile)
    return out.where(F.col("is_post") & (F.col("title") != "")).drop("is_post")


def index_grouped(nodes: DataFrame, content: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """For each grouped item (inside the content element): section =
    stripped text of the first ``a`` in its title div, else the title
    div's text, else the default section; posts = kept links of its first
    right-hand div. Returns ``page_id, item_id, link_id, title, url,
    section``."""
    el = elements(nodes)
    divs = el.where(F.col("tag") == "div")
    items = descendants_of(divs.where(has_class_token(profile.group_item_class, "contains"))
                           .select("page_id", "node_id", "end_id"),
                           content.select("page_id", "node_id", "end_id"), "left_semi", include_self=False)
    items = materialize(items.select("page_id", "node_id", "end_id"))

    def first_div_in(cls: str, name: str) -> DataFrame:
        d = divs.where(has_class_token(cls, "contains")).select("page_id", "node_id", "end_id")
        j = descendants_of(d, items, "inner", include_self=False)
        w = Window.partitionBy("page_id", "anc_node_id").orderBy("node_id")
        return (j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                .select("page_id", F.col("anc_node_id").alias("item_id"),
                        F.col("node_id").alias(name + "_id"), F.col("end_id").alias(name + "_end")))

    titles = materialize(first_div_in(profile.group_title_class, "tdiv"))
    rights = first_div_in(profile.group_links_class, "rdiv")
    def text_of(df: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
        spans = df.select("page_id", "item_id", F.col(lo).alias("node_id"), F.col(hi).alias("end_id"))
        said = node_text(nodes, spans.select("page_id", "node_id", "end_id").distinct(), out=out).drop("end_id")
        return spans.join(said, ["page_id", "node_id"]).select("page_id", "item_id", out)

    anchors = el.where(F.col("tag") == "a").select("page_id", "node_id", "end_id")
    first_a = (descendants_of(anchors, titles.select("page_id", F.col("tdiv_id").alias("node_id"), F.col("tdiv_end").alias("end_id"), "item_id"),
                              include_self=False)
               .groupBy("page_id", F.col("anc_item_id").alias("item_id")).agg(F.min_by(F.struct("node_id", "end_id"), "node_id").alias("_fa"))
               .select("page_id", "item_id", F.col("_fa.node_id").alias("_a"), F.col("_fa.end_id").alias("_ae")))
    a_text = text_of(first_a, "_a", "_ae", "a_text")
    t_text = text_of(titles, "tdiv_id", "tdiv_end", "t_text")
    sec = (items.select("page_id", F.col("node_id").alias("item_id"))
           .join(titles, ["page_id", "item_id"], "left")
           .join(first_a.select("page_id", "item_id", F.lit(True).alias("_has_a")), ["page_id", "item_id"], "left")
           .join(a_text, ["page_id", "item_id"], "left")
           .join(t_text, ["page_id", "item_id"], "left")
           .select("page_id", "item_id",
                   F.when(F.col("tdiv_id").isNull(), F.lit(profile.default_section))
                   .when(F.col("_has_a"), F.coalesce(F.col("a_text"), F.lit("")))
                   .otherwise(F.coalesce(F.col("t_text"), F.lit(""))).alias("section")))
    links = _links_in(nodes, rights.select("page_id", F.col("rdiv_id").alias("node_id"),
                                           F.col("rdiv_end").alias("end_id"), "item_id"), profile)
    return (links.withColumnRenamed("anc_item_id", "item_id").join(sec, ["page_id", "item_id"], "inner")
            .select("page_id", "item_id", F.col("node_id").alias("link_id"), "title", "url", "section"))


def index_by_heading(nodes: DataFrame, content: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Walk h1/h2/h3/ul in document order inside the content element;
    a heading sets the section (W1 carry-forward), each ``ul`` emits the
    kept links anywhere below it with the current section. Links outside
    lists are ignored; nested lists repeat links (removed by I4).
    Returns ``page_id, item_id (= ul id), link_id, title, url, section``."""
    el = elements(nodes)
    sc = content.select("page_id", "node_id", "end_id")
    walk = descendants_of(el.where(F.col("tag").isin("h1", "h2", "h3", "ul")).select("page_id", "node_id", "end_id", "tag"),
                          sc, "left_semi", include_self=False)
    heads = walk.where(F.col("tag") != "ul").select("page_id", "node_id", "end_id")
    htext = node_text(nodes, heads, out="_h").drop("end_id")
    rows = (walk.select("page_id", "node_id", "end_id", "tag")
            .join(htext, ["page_id", "node_id"], "left")
            .withColumn("_h", F.when(F.col("tag") != "ul", F.coalesce(F.col("_h"), F.lit("")))))
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(w),
                                                    F.lit(profile.default_section)))
    uls = carried.where(F.col("tag") == "ul").select("page_id", "node_id", "end_id", F.col("section").alias("section"))
    links = _links_in(nodes, uls, profile)
    return links.select("page_id", F.col("anc_node_id").alias("item_id"), F.col("node_id").alias("link_id"),
                        "title", "url", F.col("anc_section").alias("section"))


def prefer_first_non_empty(a: DataFrame, b: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of ``a``; for keys where ``a`` has none, rows of ``b``."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def dedup_keep_first(df: DataFrame, key: str | list[str], order: list, part: str | None = "page_id") -> DataFrame:
    """First occurrence per key in the given order (not
    ``dropDuplicates``, which keeps an arbitrary row). An aggregate
    ``min_by(row, order)`` with map-side partial aggregation, so a key
    holding a large share of the rows is reduced before the shuffle
    instead of landing whole in one window partition. Rows whose key is null
    count as rows of one key."""
    key = [key] if isinstance(key, str) else key
    by = ([part] if part else []) + key
    rest = [c for c in df.columns if c not in by]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return (df.groupBy(*by)
            .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order_cols)).alias("_first"))
            .select(*by, *[F.col("_first." + c).alias(c) for c in rest]))


def scan_index(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Index pages -> ordered stubs ``page_id, ordinal, title, url,
    section`` (grouped structure preferred, heading structure otherwise,
    de-duplicated by exact URL keeping the first)."""
    content = materialize(locate_index_content(nodes, profile))  # read by both structures
    grouped = index_grouped(nodes, content, profile)
    heading = index_by_heading(nodes, content, profile)
    both = prefer_first_non_empty(grouped, heading)
    first = dedup_keep_first(both, "url", ["item_id", "link_id"])
    w = Window.partitionBy("page_id").orderBy("item_id", "link_id")
    return first.select("page_id", F.row_number().over(w).cast("long").alias("ordinal"), "title", "url", "section")
