"""Element rewrites (D7-D13), link sanitising (P10), licence-block removal
(D18) and HTML -> Markdown rendering (D19) on the node table.

Everything about a page happens in windows over its scope, after one
exchange by (page_id, scope_id): "is there text below this element" is a
reverse running minimum, nesting depth is a running sum over open and
close events, and the output is built as lines -- events between two
breaks form a line, a line knows its nesting from its first event -- so
lists, quotes and code keep their shape. No interval list is copied onto
nodes and nothing loops on the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import urls
from folio.operators.dom import py_strip
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import materialize

KEY = ["page_id", "scope_id"]
BLOCK_TAGS = ["div", "section", "article", "main", "header", "aside", "figure", "details",
              "dl", "dt", "dd", "form", "fieldset", "address", "table", "nav", "footer", "body", "html"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
LISTS = ["ul", "ol"]
# ---- fixed values: labels of rewritten elements ----
EMBED_TITLE, DEFAULT_ALT, SUMMARY_MARK = "Embedded content", "Image", "▶ "


def _scope_window(*order: str):
    return Window.partitionBy(*KEY).orderBy(*(order or ("node_id",)))


def _so_far():
    return _scope_window().rowsBetween(Window.unboundedPreceding, 0)


def _above():
    """Rows before this one, among them all ancestors."""
    return _scope_window().rowsBetween(Window.unboundedPreceding, -1)


def _from_here():
    return _scope_window().rowsBetween(1, Window.unboundedFollowing)


def _inside(cond: Column) -> Column:
    """True for nodes below an element that meets ``cond``: the furthest end
    of such elements so far is not before the node."""
    return F.coalesce(F.col("node_id") <= F.max(F.when(cond, F.col("end_id"))).over(_above()), F.lit(False))


def _first_below(value: Column) -> Column:
    """The first non-null ``value`` after this node, NULL beyond its subtree."""
    nxt = F.first(F.when(value.isNotNull(), F.struct(F.col("node_id").alias("at"), value.alias("v"))), ignorenulls=True).over(_from_here())
    return F.when(nxt["at"] <= F.col("end_id"), nxt["v"])


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---------------------------------------------------------------- D7-D13, P10
def rewrite_nodes(scoped: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Apply the accessibility and inline rewrites to a cleaned scope.

    Adds per element: ``rtag`` (tag after renames), ``label`` (replacement
    text for elements whose children are replaced: empty links, embeds,
    abbreviations), ``lit_open``/``lit_close`` (literal text around
    inline elements), ``dropped`` (a link with nothing to show), and
    sanitised ``href``/``src``/``alt``/``title``. Nodes below a replaced
    element go.
    """
    a, tag, is_el = F.col("attrs"), F.col("tag"), F.col("kind") == "element"
    stripped = F.when(F.col("kind") == "text", _filled(py_strip(F.col("text"))))
    out = (scoped.withColumn("_t", stripped)
           .withColumns({"_has_text": _first_below(F.col("_t")).isNotNull(),
                         "_has_img": _first_below(F.when(tag == "img", F.lit(1))).isNotNull(),
                         "_inner_src": _first_below(F.when(tag == "source", a.getItem("src"))),
                         "_abbr": F.last(F.when(tag == "abbr", F.struct("node_id", "end_id")), ignorenulls=True).over(_so_far())}))
    # the texts of an abbreviation: those below the last one opened
    own = F.when(F.col("node_id") <= F.col("_abbr.end_id"), F.col("_abbr.node_id"))
    texts = F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("node_id", "_t"))).over(Window.partitionBy(*KEY, "_own"))
    out = (out.withColumn("_own", own)
           .withColumn("_said", F.when((tag == "abbr") & is_el, F.array_join(F.transform(F.array_sort(texts), lambda x: x["_t"]), ""))))

    is_embed = tag.isin(list(profile.embed_tags))
    aria, title0 = _filled(a.getItem("aria-label")), a.getItem("title")
    title = F.when(tag.isin("iframe", "object", "embed") & (F.coalesce(title0, F.lit("")) == ""), F.lit(EMBED_TITLE)).otherwise(title0)
    embed_src = F.coalesce(_filled(a.getItem("src")), _filled(a.getItem("data")),
                           F.when(tag.isin("video", "audio"), F.col("_inner_src")))
    empty_link = (tag == "a") & ~F.col("_has_text") & ~F.col("_has_img")
    link_label = F.coalesce(aria, _filled(title0))
    label = (F.when(is_embed, F.coalesce(aria, _filled(title), F.initcap(tag)))
             .when(empty_link, link_label)
             .when((tag == "abbr") & (F.coalesce(title0, F.lit("")) != ""), F.concat(F.col("_said"), F.lit(" ("), py_strip(title0), F.lit(")"))))
    literal = tag.isin(list(profile.inline_literal_tags))
    mark = F.when(tag == "sup", F.lit("^")).when(tag == "sub", F.lit("~"))
    alt = (F.when((tag == "img") & a.getItem("role").isin("presentation", "none"), F.lit(""))
           .when(tag == "img", F.coalesce(a.getItem("alt"), F.lit(DEFAULT_ALT))))
    out = out.withColumns({
        "rtag": F.when(is_el, F.when(is_embed, F.lit("a")).when(tag == "figcaption", F.lit("em"))
                       .when(tag == "summary", F.lit("strong")).otherwise(tag)),
        "label": F.when(is_el, label),
        "lit_open": F.when(is_el, F.when(literal, F.concat(F.lit("<"), tag, F.lit(">"))).when(tag == "summary", F.lit(SUMMARY_MARK)).otherwise(mark)),
        "lit_close": F.when(is_el, F.when(literal, F.concat(F.lit("</"), tag, F.lit(">"))).otherwise(mark)),
        "alt": F.when(is_el, alt),
        "title": F.when(is_el, F.when(is_embed, title).otherwise(title0)),
        "dropped": is_el & empty_link & link_label.isNull(),
        "href": F.when(is_el, F.when(is_embed, F.coalesce(embed_src, a.getItem("href"))).otherwise(a.getItem("href"))),
        "src": F.when(is_el, a.getItem("src")),
    }).drop("_t", "_has_text", "_has_img", "_inner_src", "_abbr", "_own", "_said")
    out = out.withColumn("_gone", _inside(F.col("label").isNotNull())).where("NOT _gone").drop("_gone")
    return sanitize_links(out, profile)


def sanitize_links(rows: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """P10: ``href`` and ``src`` of the rewritten tags, by the rules on the
    distinct values; a dangerous one becomes NULL. Only rows that have a link
    take part in the joins; the others, texts among them, are not dealt anew."""
    rows = materialize(rows)  # read for the links, their join, the licence test and the rendering
    subject = (F.col("kind") == "element") & F.col("tag").isin(list(profile.rewrite_tags))
    linked = F.coalesce(subject & (F.col("href").isNotNull() | F.col("src").isNotNull()), F.lit(False))
    links = (rows.where(linked)
             .select(*KEY, "node_id", F.explode(F.map_from_arrays(F.array(F.lit("h"), F.lit("s")), F.array("href", "src"))).alias("_k", "_v"))
             .where("_v IS NOT NULL"))
    clean = urls.sanitize_df(materialize(links.select("_v").distinct()), "_v", "_c", profile)
    done = (links.join(clean, "_v").groupBy(*KEY, "node_id")
            .agg(F.max(F.when(F.col("_k") == "h", F.col("_c"))).alias("_h"), F.max(F.when(F.col("_k") == "s", F.col("_c"))).alias("_s"),
                 F.lit(True).alias("_linked")))
    own = (rows.where(linked).join(done, KEY + ["node_id"], "left")
           .withColumns({"href": F.when(F.col("_linked"), F.col("_h")).otherwise(F.col("href")),
                         "src": F.when(F.col("_linked"), F.col("_s")).otherwise(F.col("src"))}))
    return rows.where(~linked).unionByName(own.select(*rows.columns))


# ---------------------------------------------------------------- D18
_CANDIDATES = ["p", "div", "span", "a", "blockquote"]


def drop_license_blocks(rw: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """Inside scopes whose text mentions a licence phrase, remove the
    candidate blocks (descendants of the scope) whose stripped text does,
    from the last to the first; the text of what is already removed no
    longer counts. One fold per scope that mentions a phrase."""
    phrases = [p.lower() for p in profile.license_phrases]

    def mentions(c: Column) -> Column:
        low = F.lower(c)
        return reduce(Column.__or__, [low.contains(p) for p in phrases])

    shown = F.when(F.col("kind") == "text", F.col("text")).otherwise(
        _filled(F.concat(F.coalesce("lit_open", F.lit("")), F.coalesce("label", F.lit("")))))
    pieces = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct(F.col("node_id").alias("p"), shown.alias("t")))))
    cands = F.reverse(F.array_sort(F.collect_list(F.when(
        (F.col("kind") == "element") & F.col("rtag").isin(_CANDIDATES) & (F.col("node_id") > F.col("scope_id")),
        F.struct(F.col("node_id").alias("s"), F.col("end_id").alias("e"))))))
    some = _may_mention(rw.select(*KEY, shown.alias("_t")), phrases)
    hit = (rw.join(some, KEY, "left_semi").groupBy(*KEY).agg(pieces.alias("_p"), cands.alias("_c"))
           .where(mentions(F.array_join(F.transform("_p", lambda x: x["t"]), ""))))

    def within(p: Column, r: Column) -> Column:
        return (p >= r["s"]) & (p <= r["e"])

    def step(gone, c):
        own = F.filter(F.col("_p"), lambda x: within(x["p"], c) & ~F.exists(gone, lambda r: within(x["p"], r)))
        text = F.array_join(F.transform(own, lambda x: py_strip(x["t"])), "")
        return F.when(mentions(text), F.concat(gone, F.array(c))).otherwise(gone)

    gone = hit.select(*KEY, F.aggregate("_c", F.array().cast("array<struct<s:int,e:int>>"), step).alias("_gone"))
    return (rw.join(gone, KEY, "left")
            .where(~F.coalesce(F.exists("_gone", lambda r: within(F.col("node_id"), r)), F.lit(False))).drop("_gone"))


def _may_mention(shown: DataFrame, phrases: list[str]) -> DataFrame:
    """The scopes of ``shown(page_id, scope_id, _t)`` whose pieces may hold a
    phrase: in one of them, or begun at the end of one and ended at the start of
    one. Written, as it is small: the texts of the other scopes aren't dealt for
    their phrases. (Lower case depends on the letters around for Greek only.)"""
    if not all(p.isascii() and p for p in phrases):
        return materialize(shown.select(*KEY).distinct())
    cuts, most = [(p[:i], p[i:]) for p in phrases for i in range(1, len(p))], max(map(len, phrases))
    one_of = lambda parts: "(?:" + "|".join(sorted({re.escape(x) for x in parts})) + ")"
    low, text = F.lower("_t"), F.col("_t")
    marks = {"_in": reduce(Column.__or__, [low.contains(p) for p in phrases]),
             "_end": F.lower(F.right(text, F.lit(most))).rlike(one_of([x for x, _ in cuts]) + "\\z") if cuts else F.lit(False),
             "_start": F.lower(F.left(text, F.lit(most))).rlike("\\A" + one_of([y for _, y in cuts])) if cuts else F.lit(False)}
    rows = shown.where("_t IS NOT NULL").select(*KEY, *[c.alias(n) for n, c in marks.items()]).where("_in OR _end OR _start")
    return materialize(rows.groupBy(*KEY).agg(*[F.max(n).alias(n) for n in marks]).where("_in OR _end AND _start").select(*KEY))


# ---------------------------------------------------------------- D19
def render_markdown(rw: DataFrame) -> DataFrame:
    """D19 rendering of rewritten scopes: ``page_id, scope_id, markdown``, a row
    for each scope that has a node (``''`` if it shows nothing).

    ATX headings, ``*``/``+``/``-`` bullets by depth, ``**``/``*``, ``>``
    quotes, fenced ``pre`` (its text is kept as it is), hard break = two
    spaces + newline, no escaping. White space collapses outside ``pre``."""
    lines = _lines(_events(_with_context(rw)))
    return (lines.groupBy(*KEY).agg(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY grp)").alias("_md"))
            .select(*KEY, F.coalesce(py_strip(F.col("_md")), F.lit("")).alias("markdown")))


def _with_context(rw: DataFrame) -> DataFrame:
    """Per node: whether it is in ``pre`` or a table cell, the list an item
    belongs to and its number there, and the cells of a table's first row."""
    tag = F.col("rtag")
    sibling = lambda group: Window.partitionBy(*KEY, group).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    x = rw.withColumns({
        "in_pre": _inside(tag == "pre"), "in_cell": _inside(tag.isin("td", "th")),
        "_list": F.when(tag.isin(LISTS), F.col("node_id")).when(tag == "li", F.col("parent_id")),
        "_row": F.when(tag == "tr", F.col("node_id")).when(tag.isin("td", "th"), F.col("parent_id")),
        "_table": F.last(F.when(tag == "table", F.col("node_id")), ignorenulls=True).over(_so_far())})
    start = F.coalesce(F.col("attrs").getItem("start").try_cast("int"), F.lit(1))
    number = F.sum(F.when(tag == "li", 1)).over(sibling("_list"))
    of_list = F.first(F.when(tag.isin(LISTS), F.struct("rtag", start.alias("start"))), ignorenulls=True).over(sibling("_list"))
    cells = F.sum(F.when(tag.isin("td", "th"), 1)).over(Window.partitionBy(*KEY, "_row"))
    rank = F.sum(F.when(tag == "tr", 1)).over(sibling("_table"))
    return x.withColumns({
        "ordered": F.when((tag == "li") & (of_list["rtag"] == "ol"), of_list["start"] + number - 1),
        "head_cells": F.when((tag == "tr") & F.col("_table").isNotNull() & (rank == 1), F.coalesce(cells, F.lit(0)))}).drop("_list", "_row", "_table")


def _events(x: DataFrame) -> DataFrame:
    """Two kinds of events in page order: breaks (``b`` 1: line, 2: blank line;
    an item's break carries its marker) and pieces of text; ``dl`` and ``dq``
    are the steps in list and quote depth."""
    tag, node, end = F.col("rtag"), F.col("node_id"), F.col("end_id")
    none, zero = F.lit(None).cast("string"), F.lit(0)

    def ev(p, k, z, n, b=zero, t=none, marker=none, hard=F.lit(False), dl=zero, dq=zero, listy=F.lit(False)):
        return F.struct(p.alias("p"), F.lit(k).alias("k"), z.alias("z"), F.lit(n).alias("n"), b.cast("int").alias("b"), t.alias("t"),
                        marker.alias("marker"), hard.alias("hard"), dl.cast("int").alias("dl"), dq.cast("int").alias("dq"), listy.alias("listy"))

    flow = F.col("in_cell")  # inside a cell everything stays on the row's line
    # (no breaks in pre: its lines are text)
    strength = (F.when(F.col("in_pre") | (flow & ~tag.isin("td", "th")), 0)
                .when(tag.isin("p", "pre", "blockquote", "hr", *HEADINGS, *LISTS, *BLOCK_TAGS), 2).when(tag.isin("li", "tr", "br"), 1).otherwise(0))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "",
                   F.concat(F.lit(' "'), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.lit(""))
    img_title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit(' "'), F.col("title"), F.lit('"'))).otherwise(F.lit(""))
    is_link = (tag == "a") & F.col("href").isNotNull()
    around = (F.when(tag.isin("b", "strong"), F.lit("**")).when(tag.isin("i", "em"), F.lit("*"))
              .when((tag == "code") & ~F.col("in_pre"), F.lit("`")))
    opener = F.concat_ws(
        "", F.when(tag == "img", F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), F.coalesce("src", F.lit("")), img_title, F.lit(")"))),
        F.when(tag == "hr", F.lit("---")), F.when(tag == "br", F.when(F.col("in_pre"), F.lit("\n")).when(flow, F.lit(" "))),
        F.when(tag.isin(HEADINGS), F.concat(F.repeat(F.lit("#"), F.regexp_extract(tag, "^h([1-6])$", 1).try_cast("int")), F.lit(" "))),
        F.when(tag == "tr", F.lit("|")), F.when(tag.isin("td", "th"), F.lit(" ")),
        around, "lit_open", F.when(is_link, F.lit("[")), "label")
    closer = F.concat_ws(
        "", "lit_close", F.when(is_link, F.concat(F.lit("]("), F.col("href"), title, F.lit(")"))), around,
        F.when(tag.isin("td", "th"), F.lit(" |")))
    marker = F.when((tag == "li") & ~flow, F.coalesce(F.concat(F.col("ordered").cast("string"), F.lit(".")), F.lit("*")))
    is_list, is_quote = tag.isin(LISTS) & ~flow, (tag == "blockquote") & ~flow
    step = lambda c: F.when(c, 1).otherwise(0)
    hard = tag == "br"
    z = -F.col("depth")
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("head_cells").cast("int")))
    text = F.when(F.col("in_pre"), F.col("text")).otherwise(F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "))
    element = F.array(
        ev(node, 0, zero, 0, strength, marker=marker, hard=hard, dl=step(is_list), dq=step(is_quote), listy=is_list),
        ev(node, 0, zero, 1, t=opener),
        ev(end, 2, z, 0, t=closer),
        ev(end, 2, z, 1, F.when(F.col("head_cells") > 0, 1).otherwise(0)),
        ev(end, 2, z, 2, t=F.when(F.col("head_cells") > 0, rule)),
        ev(end, 2, z, 3, F.when(hard, 0).otherwise(strength), dl=-step(is_list), dq=-step(is_quote), listy=is_list))
    shown = (F.col("kind") == "element") & ~F.coalesce(F.col("dropped"), F.lit(False))
    events = (F.when(shown & (node > F.col("scope_id")), element)
              .when(F.col("kind") == "text", F.array(ev(node, 1, zero, 0, t=text))))
    pre = F.coalesce(F.col("in_pre"), F.lit(False)) & (F.col("kind") == "text") | F.col("in_pre")
    # (a scope's root is an event without text, which keeps the scope if there is no other)
    root = F.when((F.col("kind") == "element") & (node == F.col("scope_id")), F.array(ev(node, 0, zero, 0)))
    out = x.select(*KEY, pre.alias("pre"), F.explode(F.coalesce(events, root)).alias("e")).select(*KEY, "pre", "e.*")
    return out.where((F.col("b") > 0) | (F.coalesce(F.col("t"), F.lit("")) != "") | (F.col("dl") != 0) | (F.col("dq") != 0) | (F.col("p") == F.col("scope_id")))


def _lines(ev: DataFrame) -> DataFrame:
    """Numbered output lines with the separator before each."""
    order = _scope_window("p", "k", "z", "n")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumns({"line": F.sum(F.when(F.col("b") > 0, 1).otherwise(0)).over(w),
                         "ld": F.sum("dl").over(w).cast("int"), "qd": F.sum("dq").over(w).cast("int")})
    # a list inside a list is set off by a line break only
    nested = F.col("listy") & (F.when(F.col("dl") > 0, F.col("ld") > 1).otherwise(F.col("ld") > 0))
    ev = ev.withColumn("b", F.when(nested, F.least("b", F.lit(1))).otherwise(F.col("b")))
    bullet = F.when(F.col("marker") == "*", F.element_at(F.array(F.lit("*"), F.lit("+"), F.lit("-")), (F.greatest("ld", F.lit(1)) - 1) % 3 + 1)).otherwise(F.col("marker"))
    ev = ev.withColumn("marker", F.when(F.col("marker").isNotNull(), F.concat(bullet, F.lit(" "))))
    first = lambda c: F.min_by(F.when(F.col("t").isNotNull(), F.col(c)), F.when(F.col("t").isNotNull(), F.struct("p", "k", "z", "n")))
    raw = ev.groupBy(*KEY, "line").agg(
        F.max("b").alias("b"), F.max("marker").alias("marker"), F.max("hard").alias("hard"), F.max("pre").alias("pre"),
        first("ld").alias("ld"), first("qd").alias("qd"),
        F.expr("listagg(t, '') WITHIN GROUP (ORDER BY p, k, z, n)").alias("t"))
    flat = py_strip(F.regexp_replace("t", " {2,}", " "))
    kept = F.regexp_replace(F.regexp_replace("t", "^\\r?\\n", ""), "\\s+\\z", "")
    raw = raw.withColumn("t", _filled(F.when(F.col("pre"), kept).otherwise(flat)))
    # lines without text pass their break and marker on to the next with text
    before = _scope_window("line").rowsBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("grp", F.coalesce(F.sum(F.when(F.col("t").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))
    by_line = lambda c: F.max_by(c, F.when(F.col("t").isNotNull(), F.col("line")))
    full = raw.groupBy(*KEY, "grp").agg(
        F.max("b").alias("b"), F.max("hard").alias("hard"), by_line(F.col("pre")).alias("pre"), by_line(F.col("ld")).alias("ld"),
        by_line(F.col("qd")).alias("qd"), by_line(F.col("t")).alias("t"),
        F.expr("listagg(marker, '') WITHIN GROUP (ORDER BY line)").alias("marker"))
    quote = F.repeat(F.lit("> "), F.col("qd"))
    # an item's text is indented by its list, what follows in the item by one more
    indent = F.repeat(F.lit("  "), F.greatest(F.col("ld") - F.when(F.col("marker").isNotNull(), 1).otherwise(0), F.lit(0)).cast("int"))
    after = F.concat(quote, F.repeat(F.lit("  "), F.greatest("ld", F.lit(0))))
    fenced = F.concat(F.lit("```\n"), F.col("t"), F.lit("\n```"))
    body = F.when(F.col("pre"), F.regexp_replace(fenced, "\n", F.concat(F.lit("\n"), after))).otherwise(F.col("t"))
    w2 = _scope_window("grp")
    gap = F.rtrim(F.repeat(F.lit("> "), F.least(F.col("qd"), F.coalesce(F.lag("qd").over(w2), F.lit(0)).cast("int"))))
    sep = (F.when(F.col("grp") == 0, F.lit("")).when(F.col("b") >= 2, F.concat(F.lit("\n"), gap, F.lit("\n")))
           .otherwise(F.concat(F.when(F.col("hard"), F.lit("  ")).otherwise(F.lit("")), F.lit("\n"))))
    return full.select(*KEY, "grp", F.concat(sep, quote, indent, F.coalesce("marker", F.lit("")), body).alias("t"))


def html_to_markdown(scoped: DataFrame, profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """D19 end to end on a cleaned scope (after ``drop_noise``): rewrites
    and link sanitising (D7-D13, P10), licence-block removal (D18), then
    rendering. Returns ``page_id, scope_id, markdown``; scopes whose
    content is empty get ``''``."""
    return render_markdown(drop_license_blocks(rewrite_nodes(scoped, profile), profile))
