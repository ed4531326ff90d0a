"""Main-content selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.dom import elements, first_match, has_class_token, subtree_text_length
from folio.profile import DEFAULT_PROFILE, SiteProfile


def find_body(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Per page the first ``div`` with an exact body class token, else
    the first ``div[itemprop=articleBody]``, else the first ``article``.
    Returns ``page_id, node_id, end_id, rule``."""
    el = elements(nodes)
    is_div = F.col("tag") == "div"
    rank = (F.when(is_div & has_class_token(list(profile.body_classes), "exact"), F.lit(1))
            .when(is_div & (F.col("attrs").getItem("itemprop") == profile.body_itemprop), F.lit(2))
            .when(F.col("tag") == "article", F.lit(3)))
    cand = el.select("page_id", "node_id", "end_id", rank.alias("rule")).where(F.col("rule").isNotNull())
    return first_match(cand, "page_id", ["rule", "node_id"])


def largest_div(nodes: DataFrame) -> DataFrame:
    """The ``div`` with the most visible descendant text (characters,
    whitespace included; comments and script/style text excluded; divs
    without text ignored). Ties go to the div whose first text comes
    first, then to the innermost. Returns ``page_id, node_id, end_id,
    text_len``."""
    divs = elements(nodes).where(F.col("tag") == "div").select("page_id", "node_id", "end_id", "depth")
    # text_len > 0 guarantees first_text lies inside the div
    ranked = subtree_text_length(nodes, divs).where(F.col("text_len") > 0)
    w = Window.partitionBy("page_id").orderBy(F.desc("text_len"), F.asc("first_text"), F.desc("depth"))
    return (ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("page_id", "node_id", "end_id", "text_len"))


def choose_body(nodes: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """D15 then D16 per page: ``page_id, node_id, end_id, rule`` where
    rule 1-3 are the selectors and 4 the largest-div fallback. Pages with
    neither are absent (D17 placeholder applies)."""
    sel = find_body(nodes, profile)
    fallback = (largest_div(nodes).join(sel.select("page_id"), "page_id", "left_anti")
                .select("page_id", "node_id", "end_id", F.lit(4).alias("rule")))
    return sel.unionByName(fallback)
