"""Cleaning of an extraction scope.

A scope is an element per page (the chosen body). Removal rules are
evaluated on the scope's descendants only -- the scope root itself is
never tested (D5) -- and a node is dropped when it lies in the subtree of
any matching element, so descendants of a removed element are never
processed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import split_lines_expr
from folio.operators import dom
from folio.operators.dom import has_class_token
from folio.profile import DEFAULT_PROFILE, SiteProfile


def scope_nodes(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Nodes inside each scope subtree, tagged with ``scope_id`` and
    ``scope_end`` (the scope root's interval). ``scopes(page_id, node_id,
    end_id)`` may nest; the sweep of J4 finds them."""
    inside = dom.descendants_of(nodes, scopes.select("page_id", "node_id", "end_id"))
    return inside.withColumnsRenamed({"anc_node_id": "scope_id", "anc_end_id": "scope_end"})


def removal_rule(profile: SiteProfile = DEFAULT_PROFILE) -> Column:
    """D2-D4 as one predicate on element rows: aria-hidden exactly 'true'
    (any tag), a noise tag, or a ``div`` with a class token containing the
    comment-section marker (case-insensitive)."""
    return ((F.col("kind") == "element")
            & ((F.col("attrs").getItem("aria-hidden") == "true")
               | F.col("tag").isin(list(profile.noise_tags))
               | ((F.col("tag") == "div") & has_class_token(profile.comment_class_token, "icontains"))))


def drop_noise(scoped: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Remove the subtrees of noise, hidden and comment-section
    elements inside each scope (root excluded). Subtrees nest, so a node is
    inside one exactly if the furthest end of those opened so far isn't before
    it: one window in document order, no list of intervals."""
    w = Window.partitionBy("page_id", "scope_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.when(removal_rule(profile) & (F.col("node_id") > F.col("scope_id")), F.col("end_id"))
    return (scoped.withColumn("_gone", F.max(end).over(w)).where("_gone IS NULL OR _gone < node_id").drop("_gone"))


def drop_license_lines(docs: DataFrame, text_col: str = "text",
                       profile: SiteProfile = DEFAULT_PROFILE, key: str = "doc_id") -> DataFrame:
    """Drop the lines of a plain text that mention a licence phrase
    (case-insensitive); other lines -- and other licences -- stay. Lines
    split on Python line boundaries and re-joined with ``\\n``."""
    pattern = "|".join(_re_escape(p) for p in profile.license_phrases)
    kept = F.filter(split_lines_expr(F.col(text_col)), lambda x: ~F.lower(x).rlike(pattern))
    return docs.select(key, F.array_join(kept, "\n").alias(text_col))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)
