"""Registered DOM, cleaning, rendering, metadata and index queries.

Two kinds of input:

* the given ``pages`` table (D1, D2, D6, D16, D20, A4, J4, K3): the
  oracle recomputes the same facts from the raw HTML with DuckDB regular
  expressions;
* round-trip stand-ins built from ``documents`` (every row): the HTML is
  written by one SQL expression shared by Spark (``F.expr``) and DuckDB,
  the operator runs on it in Spark, and the oracle returns the source
  columns the operator must recover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import body, clean, dom, index, metadata, posts, render
from folio.plans.catalog import page_nodes, register
from folio.plans.sqlkit import html_decode_sql, strip_tags_sql
from folio.profile import DEFAULT_PROFILE as PR
from folio.session import materialize
from folio.sources.pages import table

# ---------------------------------------------------------------- helpers
ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SRC = "source"
ID = "CAST(doc_id AS STRING)"
POST_URL = f"concat('{PR.base_url}/posts/', {ID}, '/x')"
COLLAPSED = "trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
# a text paragraph that itself mentions a licence phrase is removed by D18
_MENTIONS = " OR ".join(f"contains(lower(text), '{p}')" for p in PR.license_phrases)
BODY_MD = f"(CASE WHEN {_MENTIONS} THEN '' ELSE {COLLAPSED} END)"


def _doc_pages(spark, sf_dir, html_sql: str, url_sql: str = POST_URL) -> DataFrame:
    """``pages(page_id, url, html)`` built row by row from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), F.expr(url_sql).alias("url"),
                       F.expr(html_sql).alias("html"))


def _nodes_of(pages: DataFrame) -> DataFrame:
    return materialize(dom.html_nodes(pages))


def _page(head: str, body_sql: str) -> str:
    return f"concat('<!DOCTYPE html><html><head><title>', {SRC}, '</title>', {head}, '</head><body>', {body_sql}, '</body></html>')"


# ======================================================================
# Queries on the given pages table
# ======================================================================

@register("d1_html_nodes", """
SELECT page_id, lower(t) AS tag, CAST(count(*) AS BIGINT) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)[^>]*>', 1)) AS t FROM pages)
GROUP BY 1, 2
""")
def d1_html_nodes(spark, sf_dir):
    """Parse every page into the node table; element counts by tag."""
    nodes = page_nodes(spark, sf_dir)
    return (dom.elements(nodes).groupBy("page_id", "tag")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# ids that are null, shared by many documents, or their own; every fourth row is there twice
_KEYS = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 5 ELSE doc_id END"


@register("d1_keys", f"""
WITH d AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 4 = 0)
SELECT {_KEYS} AS page_id, {POST_URL} AS url, {SRC} AS author, {BODY_MD} AS markdown FROM d
""")
def d1_keys(spark, sf_dir):
    """D1 / M10 on pages whose ids are null or repeated, and on repeated
    rows: one post for each input row."""
    html = _page(f"concat('<meta name=\"author\" content=\"', {SRC}, '\">')", f"concat('<div class=\"postBody\"><p>', {ESC}, '</p></div>')")
    pages = _doc_pages(spark, sf_dir, html)
    pages = pages.unionByName(pages.where("page_id % 4 = 0")).withColumn("page_id", F.expr(_KEYS.replace("doc_id", "page_id")))
    return posts.extract_posts(pages).select("page_id", "url", "author", "markdown")


_BODY_SQL = "regexp_extract(html, '(?s)<body>(.*?)(</body>|$)', 1)"
_NO_NOISE = _BODY_SQL
for _t in ("nav", "footer", "script", "style", "noscript"):
    _NO_NOISE = f"regexp_replace({_NO_NOISE}, '(?s)<{_t}[ >].*?(</{_t}>|$)', '', 'g')"
_NO_NOISE = f"regexp_replace({_NO_NOISE}, '(?s)<!--.*?(-->|$)', '', 'g')"


@register("d2_drop_noise_tags", f"""
SELECT page_id, {html_decode_sql(strip_tags_sql(_NO_NOISE))} AS text FROM pages
""")
def d2_drop_noise_tags(spark, sf_dir):
    """The body element of every page with nav, footer, script,
    style, noscript (and hidden / comment-section) subtrees removed;
    remaining visible text."""
    nodes = page_nodes(spark, sf_dir)
    bodies = dom.elements(nodes).where(F.col("tag") == "body").select("page_id", "node_id", "end_id")
    kept = clean.drop_noise(clean.scope_nodes(nodes, bodies))
    txt = (kept.where(F.col("kind") == "text").groupBy("page_id")
           .agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY node_id)").alias("text")))
    return (table(spark, sf_dir, "pages").select("page_id").join(txt, "page_id", "left")
            .select("page_id", F.coalesce("text", F.lit("")).alias("text")))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"


@register("d6_node_text", f"""
SELECT page_id,
  array_to_string(list_transform(regexp_split_to_array({_ARTICLE}, '<[^>]*>'),
                                 lambda s: trim({html_decode_sql('s')})), '') AS text
FROM pages
""")
def d6_node_text(spark, sf_dir):
    """D6 (stripped form) + D15 rule 3: text of each page's ``article``
    with every text node trimmed and joined without separator."""
    nodes = page_nodes(spark, sf_dir)
    art = body.find_body(nodes)
    t = dom.node_text(nodes, art, strip=True, out="text")
    return (table(spark, sf_dir, "pages").select("page_id").join(t.select("page_id", "text"), "page_id", "left")
            .select("page_id", F.coalesce("text", F.lit("")).alias("text")))


@register("d16_largest_div", f"""
SELECT page_id, CAST(length({html_decode_sql("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}) AS BIGINT) AS text_len,
       {html_decode_sql("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS text
FROM pages WHERE regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) <> ''
""")
def d16_largest_div(spark, sf_dir):
    """The div with most visible descendant text per page,
    with its length and text."""
    nodes = page_nodes(spark, sf_dir)
    big = body.largest_div(nodes)
    t = dom.node_text(nodes, big, strip=False, out="text")
    return big.join(t.select("page_id", "node_id", "text"), ["page_id", "node_id"]).select("page_id", "text_len", "text")


@register("d20_page_links", f"""
SELECT page_id, CAST(i AS BIGINT) AS ordinal, href, trim({html_decode_sql('anchor')}) AS anchor FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS i
  FROM pages)
""")
def d20_page_links(spark, sf_dir):
    """Every anchor with an href, in document order, with stripped
    anchor text."""
    nodes = page_nodes(spark, sf_dir)
    links = dom.page_links(nodes)
    from pyspark.sql import Window
    w = Window.partitionBy("page_id").orderBy("node_id")
    return links.select("page_id", F.row_number().over(w).cast("bigint").alias("ordinal"), "href", "anchor")


@register("j4_descendants_of", """
SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)(</nav>|$)', 1), '<(li|a)[ >]', 0)) AS BIGINT) AS n_desc
FROM pages
""")
def j4_descendants_of(spark, sf_dir):
    """Containment join -- element descendants (li, a) of each page's
    ``nav``."""
    nodes = page_nodes(spark, sf_dir)
    navs = dom.elements(nodes).where(F.col("tag") == "nav").select("page_id", "node_id", "end_id")
    d = dom.descendants_of(dom.elements(nodes).where(F.col("tag").isin("li", "a")), navs, "inner", include_self=False)
    return (table(spark, sf_dir, "pages").select("page_id")
            .join(d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left")
            .select("page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_desc")))


@register("k3_first_match", f"""
SELECT page_id, trim({html_decode_sql("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS first_heading FROM pages
""")
def k3_first_match(spark, sf_dir):
    """K3: first element in document order matching a predicate (first
    ``h1``), with its stripped text."""
    nodes = page_nodes(spark, sf_dir)
    h = dom.first_match(dom.elements(nodes).where(F.col("tag") == "h1").select("page_id", "node_id", "end_id"))
    t = dom.node_text(nodes, h, strip=True, out="first_heading")
    return t.select("page_id", "first_heading")


# ======================================================================
# Round trips built from documents
# ======================================================================

# --- body selection (D15-D17) -------------------------------------------
_BODY_CASE = (
    f"CASE doc_id % 5"
    f" WHEN 0 THEN concat('<div class=\"wrap postBody\"><p>', {ESC}, '</p></div>')"
    f" WHEN 1 THEN concat('<div itemprop=\"articleBody\"><p>', {ESC}, '</p></div>')"
    f" WHEN 2 THEN concat('<article><p>', {ESC}, '</p></article>')"
    f" WHEN 3 THEN concat('<div class=\"main\"><p>', {ESC}, '</p></div><div class=\"side\">x</div>')"
    f" ELSE concat('<p>', {ESC}, '</p>') END")


@register("d17_body_or_placeholder", f"""
SELECT doc_id AS page_id,
       CAST(CASE doc_id % 5 WHEN 4 THEN 0 ELSE doc_id % 5 + 1 END AS BIGINT) AS rule,
       CASE WHEN doc_id % 5 = 4 THEN concat('*Content could not be extracted from ', {POST_URL}, '*')
            ELSE {BODY_MD} END AS markdown
FROM documents
""")
def d17_body_or_placeholder(spark, sf_dir):
    """D15 -> D16 -> D17 with D19: body by class / itemprop / article /
    largest div, rendered to Markdown; the placeholder when no body
    exists. ``rule`` 1-4 as chosen, 0 = placeholder."""
    pages = _doc_pages(spark, sf_dir, _page("''", _BODY_CASE))
    return posts.extract_posts(pages).select("page_id", "rule", "markdown")


# --- noise / hidden / comment sections (D2-D5) ---------------------------
_NOISY = (f"concat('<div class=\"postBody\" aria-hidden=\"true\"><nav><a href=\"/n\">menu</a></nav><p>', {ESC},"
          f" '</p><span aria-hidden=\"true\">hidden ', {SRC}, '</span><div class=\"x CommentsSection\"><p>c ', {SRC},"
          f" '</p></div><script>var a = \"', {SRC}, '\";</script><footer>f</footer><noscript>n</noscript></div>')")


@register("d3_drop_hidden", f"SELECT doc_id AS page_id, {BODY_MD} AS markdown FROM documents")
def d3_drop_hidden(spark, sf_dir):
    """D2-D5 round trip: nav, hidden span, comment-section div, script,
    footer, noscript removed inside the body (whose own aria-hidden is
    never tested); the text survives."""
    pages = _doc_pages(spark, sf_dir, _page("''", _NOISY))
    nodes = _nodes_of(pages)
    md = render.html_to_markdown(clean.drop_noise(clean.scope_nodes(nodes, body.find_body(nodes))))
    return md.select("page_id", "markdown")


# --- licence blocks (D18) -------------------------------------------------
_LIC = (f"concat('<div class=\"postBody\"><p>', {ESC}, '</p>', CASE doc_id % 3"
        f" WHEN 0 THEN '<div><span>This post is licensed under CC BY 4.0.</span></div>'"
        f" WHEN 1 THEN '<p>Licensed under the MIT License.</p>' ELSE '' END, '</div>')")


@register("d18_drop_license_blocks", f"""
SELECT doc_id AS page_id,
  CASE doc_id % 3 WHEN 1 THEN concat_ws(chr(10) || chr(10), NULLIF({BODY_MD}, ''), 'Licensed under the MIT License.')
  ELSE {BODY_MD} END AS markdown
FROM documents
""")
def d18_drop_license_blocks(spark, sf_dir):
    """D18 round trip: Creative Commons blocks removed innermost-first
    (the wrapper survives), other licences kept."""
    pages = _doc_pages(spark, sf_dir, _page("''", _LIC))
    nodes = _nodes_of(pages)
    md = render.html_to_markdown(clean.drop_noise(clean.scope_nodes(nodes, body.find_body(nodes))))
    return md.select("page_id", "markdown")


# --- rewrites and link sanitising (D7-D13, P7-P10) ------------------------
_B = PR.base_url
_ELEMENTS = [
    (f"concat('<a href=\"/posts/', {ID}, '\" aria-label=\"', {SRC}, '\"></a>')",
     f"concat('[', {SRC}, '](', '{_B}/posts/', {ID}, ')')"),
    (f"concat('<img src=\"/img/', {ID}, '.png\">')", f"concat('![Image]({_B}/img/', {ID}, '.png)')"),
    (f"concat('<img src=\"/img/', {ID}, '.png\" role=\"presentation\" alt=\"', {SRC}, '\">')",
     f"concat('![]({_B}/img/', {ID}, '.png)')"),
    (f"concat('<iframe src=\"https://video.example.com/', {ID}, '\" title=\"', {SRC}, '\"></iframe>')",
     f"concat('[', {SRC}, '](https://video.example.com/', {ID}, ' \"', {SRC}, '\")')"),
    (f"concat('<abbr title=\" ', {SRC}, ' \">AB', {ID}, '</abbr>')", f"concat('AB', {ID}, ' (', {SRC}, ')')"),
    (f"concat('<figcaption>', {SRC}, '</figcaption>')", f"concat('*', {SRC}, '*')"),
    (f"concat('<kbd>', {SRC}, '</kbd>')", f"concat('<kbd>', {SRC}, '</kbd>')"),
    (f"concat('x<sup>', {ID}, '</sup>')", f"concat('x^', {ID}, '^')"),
    (f"concat('<a href=\"javascript:alert(', {ID}, ')\">', {SRC}, '</a>')", SRC),
    (f"concat('<a href=\"http://forum.example.org/out?url=https%3A%2F%2Fext.example.com%2F', {ID}, '\">', {SRC}, '</a>')",
     f"concat('[', {SRC}, '](https://ext.example.com/', {ID}, ')')"),
    (f"concat('<summary>', {SRC}, '</summary>')", f"concat('**▶ ', {SRC}, '**')"),
    (f"concat('<video><source src=\"/v/', {ID}, '.mp4\"></video>')", f"concat('[Video]({_B}/v/', {ID}, '.mp4)')"),
    (f"concat('<a href=\"&#x6A;ava&#x09;script:x', {ID}, '\">', {SRC}, '</a>')", SRC),
    (f"concat('<a href=\"%6A%61vascript:x', {ID}, '\">', {SRC}, '</a>')", SRC),
    (f"concat('<object aria-label=\"', {SRC}, '\" data=\"/o/', {ID}, '.bin\"></object>')",
     f"concat('[', {SRC}, '](', '{_B}/o/', {ID}, '.bin \"Embedded content\")')"),
    (f"concat('<a href=\"/out?url=javascript%3Aalert(', {ID}, ')\">', {SRC}, '</a>')", SRC),
    (f"concat('<a href=\"mailto:a', {ID}, '@example.org\">', {SRC}, '</a>')", f"concat('[', {SRC}, '](mailto:a', {ID}, '@example.org)')"),
    (f"concat('<img src=\"{_B}/out?url=/etc/', {ID}, '\">')", f"concat('![Image]({_B}/etc/', {ID}, ')')"),
    (f"concat('<q>', {SRC}, '</q> H<sub>2</sub>O')", f"concat('<q>', {SRC}, '</q> H~2~O')"),
    (f"concat('<a href=\"/posts/', {ID}, '\" title=\"', {SRC}, '\"><img src=\"/i.png\" alt=\"', {SRC}, '\"></a>')",
     f"concat('[![', {SRC}, ']({_B}/i.png)]({_B}/posts/', {ID}, ' \"', {SRC}, '\")')"),
]
_N_EL = len(_ELEMENTS)
_EL_HTML = "CASE doc_id % " + str(_N_EL) + "".join(
    f" WHEN {i} THEN {h}" for i, (h, _) in enumerate(_ELEMENTS)) + " END"
_EL_MD = "CASE doc_id % " + str(_N_EL) + "".join(
    f" WHEN {i} THEN {m}" for i, (_, m) in enumerate(_ELEMENTS)) + " END"


@register("d19_rewrites_and_links", f"SELECT doc_id AS page_id, {_EL_MD} AS markdown FROM documents")
def d19_rewrites_and_links(spark, sf_dir):
    """D7-D13 + P7-P10 round trip: one rewritten or sanitised element per
    document (empty-link label, image alt rules, embeds to links, abbr
    expansion, caption, summary, literal inline tags, sup/sub, hidden
    dangerous schemes, redirect unwrapping, absolute links), rendered by
    D19."""
    pages = _doc_pages(spark, sf_dir, _page("''", f"concat('<div class=\"postBody\"><p>', {_EL_HTML}, '</p></div>')"))
    nodes = _nodes_of(pages)
    md = render.html_to_markdown(clean.drop_noise(clean.scope_nodes(nodes, body.find_body(nodes))))
    return md.select("page_id", "markdown")


# --- blocks (D19): lists, code, quotes and tables of every document ---------
_W = f"regexp_replace({SRC}, '[^a-z0-9]', '')"
_BLOCKS = [
    (f"concat('<ol>\n<li>', {SRC}, '</li>\n<li>two</li>\n<li>', {ID}, '</li>\n</ol>')",
     f"concat('1. ', {SRC}, chr(10), '2. two', chr(10), '3. ', {ID})"),
    (f"concat('<ul><li>', {SRC}, '<ul><li>in</li><li>', {ID}, '</li></ul></li><li>out</li></ul>')",
     f"concat('* ', {SRC}, chr(10), '  + in', chr(10), '  + ', {ID}, chr(10), '* out')"),
    (f"concat('<ul>\n <li><p>', {SRC}, '</p></li>\n <li><p>', {ID}, '</p>\n<p>more</p></li></ul>')",
     f"concat('* ', {SRC}, chr(10), chr(10), '* ', {ID}, chr(10), chr(10), '  more')"),
    (f"concat('<pre>if x:\n    ', {SRC}, '\n\n\n  ', {ID}, '\n</pre><p>end</p>')",
     f"concat('```', chr(10), 'if x:', chr(10), '    ', {SRC}, chr(10), chr(10), chr(10), '  ', {ID}, chr(10), '```', chr(10), chr(10), 'end')"),
    (f"concat('<blockquote>\n<p>', {SRC}, '</p>\n<p>', {ID}, '</p></blockquote><p>end</p>')",
     f"concat('> ', {SRC}, chr(10), '>', chr(10), '> ', {ID}, chr(10), chr(10), 'end')"),
    (f"concat('<table><tr><th>a</th><th>', {SRC}, '</th></tr><tr><td>', {ID}, '</td><td>b</td></tr></table>')",
     f"concat('| a | ', {SRC}, ' |', chr(10), '| --- | --- |', chr(10), '| ', {ID}, ' | b |')"),
]
_BL_HTML = f"CASE doc_id % {len(_BLOCKS)}" + "".join(f" WHEN {i} THEN {h}" for i, (h, _) in enumerate(_BLOCKS)) + " END"
_BL_MD = f"CASE doc_id % {len(_BLOCKS)}" + "".join(f" WHEN {i} THEN {m}" for i, (_, m) in enumerate(_BLOCKS)) + " END"


@register("d19_blocks", f"SELECT doc_id AS page_id, concat_ws(chr(10) || chr(10), {_BL_MD}, NULLIF({BODY_MD}, '')) AS markdown FROM documents")
def d19_blocks(spark, sf_dir):
    """D19 round trip: ordered, nested and loose lists, indented code with
    blank lines, quotes of two paragraphs, tables, before each text."""
    pages = _doc_pages(spark, sf_dir, _page("''", f"concat('<div class=\"postBody\">', {_BL_HTML}, '<p>', {ESC}, '</p></div>')"))
    return posts.extract_posts(pages).select("page_id", "markdown")


_DEEP = (f"concat('<div class=\"postBody\"><p>', {ESC}, '</p>', CASE doc_id % 3"
         f" WHEN 0 THEN concat(repeat('<div>', 45), '<span>Licensed under CC BY 4.0.</span>', repeat('</div>', 45))"
         f" WHEN 1 THEN '<p>Under <abbr title=\"Creative Commons\">C</abbr></p>'"
         f" ELSE '<p>See <a href=\"/l\" title=\"CC BY\"></a></p>' END, '</div>')")


# the link goes first; what is left of its paragraph no longer mentions a licence
@register("d18_nested", f"SELECT doc_id AS page_id, concat_ws(chr(10) || chr(10), NULLIF({BODY_MD}, ''), CASE doc_id % 3 WHEN 2 THEN 'See' END) AS markdown FROM documents")
def d18_nested(spark, sf_dir):
    """D18 round trip: licence text 45 elements deep, and licences that only
    an abbreviation's or an empty link's title names."""
    return posts.extract_posts(_doc_pages(spark, sf_dir, _page("''", _DEEP))).select("page_id", "markdown")


_P10 = ["'javascript:x'", "'&#x6A;ava&#x0A;script:x'", "'%6A%61vascript:x'", "'/out?url=vbscript%3Ax'", "'DATA:text/html,x'",
        f"concat('/a/', {ID})", f"concat('https://x.example.com/', {ID})", f"concat('/out?url=https%3A%2F%2Fy.example.com%2F', {ID})", "'#top'", "''"]
_P10_OUT = ["NULL", "NULL", "NULL", "NULL", "NULL", f"concat('{_B}/a/', {ID})", f"concat('https://x.example.com/', {ID})",
            f"concat('https://y.example.com/', {ID})", "'#top'", "''"]


def _p10(values) -> str:
    return "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@register("p10_sanitize_links", f"SELECT doc_id AS page_id, {_p10(_P10_OUT)} AS href, {_p10(_P10_OUT)} AS src FROM documents")
def p10_sanitize_links(spark, sf_dir):
    """P10: ``href`` of a link and ``src`` of an image per document,
    sanitised on the node table."""
    link = _p10(_P10)
    pages = _doc_pages(spark, sf_dir, _page("''", f"concat('<div class=\"postBody\"><a href=\"', {link}, '\">t</a><img src=\"', {link}, '\"></div>')"))
    nodes = _nodes_of(pages)
    rw = render.rewrite_nodes(clean.scope_nodes(nodes, body.find_body(nodes)))
    return (rw.where(F.col("tag").isin("a", "img")).groupBy("page_id")
            .agg(F.max(F.when(F.col("tag") == "a", F.col("href"))).alias("href"), F.max(F.when(F.col("tag") == "img", F.col("src"))).alias("src")))


# --- metadata (M1-M10) ------------------------------------------------------
_DATE_SPARK = "CAST(date_add(DATE'2020-01-01', CAST(doc_id % 1000 AS INT)) AS STRING)"
_DATE_DUCK = "CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR)"


def _meta_html(date: str) -> str:
    a = "doc_id % 4"
    d = "CAST(floor(doc_id / 4) AS BIGINT) % 4"
    ts = f"concat({date}, 'T08:00:00Z')"
    ld_author = (f"CASE WHEN {a} = 0 AND doc_id % 8 = 0 THEN concat('\"author\": {{\"@type\": \"Person\", \"name\": \"', {SRC}, '\"}}')"
                 f" WHEN {a} = 0 THEN concat('\"author\": \"', {SRC}, '\"') ELSE '\"author\": [\"x\"]' END")
    ld_date = f"CASE WHEN {d} = 0 THEN concat(', \"datePublished\": \"', {ts}, '\"') ELSE '' END"
    head = (f"concat('<script type=\"application/ld+json\">{{\"@type\": \"Article\", ', {ld_author}, {ld_date}, '}}</script>',"
            f" '<script type=\"application/ld+json\">not json</script>',"
            f" CASE WHEN {a} = 1 THEN concat('<meta name=\"author\" content=\" <b>', {SRC}, '</b>  \">') ELSE '' END,"
            f" CASE WHEN {d} = 1 THEN concat('<meta property=\"article:published_time\" content=\"', {ts}, '\">') ELSE '' END)")
    body_sql = (f"concat(CASE WHEN doc_id % 11 = 3 THEN concat('<p>', {ESC}, '</p>') ELSE concat('<div class=\"postBody\"><p>', {ESC}, '</p></div>') END,"
                f" CASE WHEN {a} = 2 THEN concat('<p class=\"byline\"><a class=\"UsersName-root\" href=\"/u\">', {SRC}, '</a></p>') ELSE '' END,"
                f" CASE WHEN {d} = 2 THEN concat('<time datetime=\"', {ts}, '\">', {date}, '</time>') ELSE '' END)")
    return _page(head, body_sql)


@register("m10_extract_posts", f"""
SELECT doc_id AS page_id, {POST_URL} AS url,
       CASE doc_id % 4 WHEN 3 THEN '' ELSE source END AS author,
       CASE WHEN CAST(floor(doc_id / 4) AS BIGINT) % 4 = 3 THEN '' ELSE {_DATE_DUCK} END AS posted_date,
       CASE WHEN doc_id % 11 = 3 THEN concat('*Content could not be extracted from ', {POST_URL}, '*') ELSE {BODY_MD} END AS markdown
FROM documents
""")
def m10_extract_posts(spark, sf_dir):
    """M1-M10 round trip: author from JSON-LD (object or string) / meta
    (tags and whitespace cleaned) / byline, date from JSON-LD / meta /
    ``time``, body Markdown -- one filled post row per page."""
    return posts.extract_posts(_doc_pages(spark, sf_dir, _meta_html(_DATE_SPARK))).drop("rule")


register("m8_author", f"""
SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE source END AS author FROM documents
""")(lambda spark, sf_dir: metadata.extract_author(
    _nodes_of(_doc_pages(spark, sf_dir, _meta_html(_DATE_SPARK)))))

register("m9_posted_date", f"""
SELECT doc_id AS page_id,
       CASE WHEN CAST(floor(doc_id / 4) AS BIGINT) % 4 = 3 THEN '' ELSE {_DATE_DUCK} END AS posted_date
FROM documents
""")(lambda spark, sf_dir: metadata.posted_date(
    _nodes_of(_doc_pages(spark, sf_dir, _meta_html(_DATE_SPARK)))))


# --- index (D14, I1-I4, S8) -------------------------------------------------
_BUCKET = "CAST(floor(doc_id / 50) AS BIGINT)"
_IDX_PAGE = f"({_BUCKET} * 1000000 + ascii(lang) * 1000 + ascii(substr(lang, 2, 1)))"
_HEAD_ITEM = (f"concat('<h2>', {SRC}, '</h2><ul><li><a href=\"/posts/', {ID}, '/x\">Post ', {ID}, '</a></li></ul>',"
              f" CASE WHEN doc_id % 7 = 0 THEN concat('<ul><li><ul><li><a href=\"/posts/', {ID}, '/x\">Again</a></li></ul></li></ul>') ELSE '' END,"
              f" '<p><a href=\"/posts/', {ID}, '/p\">outside</a></p><ol><li><a href=\"/posts/', {ID}, '/o\">ol</a></li></ol>')")
_GROUP_ITEM = (f"concat('<div class=\"LargeSequencesItem-columns\"><div class=\"LargeSequencesItem-titleAndAuthor\">"
               f"<a href=\"/s/', {SRC}, '\">', {SRC}, '</a></div><div class=\"LargeSequencesItem-right\">"
               f"<a href=\"/posts/', {ID}, '/x\">Post ', {ID}, '</a><a href=\"https://other.example.com/posts/', {ID}, '\">ext</a>"
               f"<a href=\"\">empty</a></div></div>')")
_IDX_ITEM = f"CASE WHEN {_BUCKET} % 2 = 0 THEN {_HEAD_ITEM} ELSE {_GROUP_ITEM} END"


@register("s8_scan_index", f"""
SELECT {_IDX_PAGE} AS page_id,
       CAST(row_number() OVER (PARTITION BY {_IDX_PAGE} ORDER BY doc_id) AS BIGINT) AS ordinal,
       concat('Post ', CAST(doc_id AS VARCHAR)) AS title, {POST_URL} AS url, source AS section
FROM documents
""")
def s8_scan_index(spark, sf_dir):
    """S8 = D14 + I1/I2 + I3 + I4 round trip: index pages (one per
    language and block of 50 documents; heading form or grouped form by
    block) are parsed, their content element located, post links
    extracted with sections, duplicates removed keeping the first, and
    stubs numbered in index order."""
    nodes = _nodes_of(_index_pages(spark, sf_dir))
    return index.scan_index(nodes).select("page_id", "ordinal", "title", "url", "section")


def _index_pages(spark, sf_dir) -> DataFrame:
    """Index pages: one per language and block of 50 documents, items in
    document order (each page holds at most 50 items)."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.expr(_IDX_PAGE).alias("page_id"), "doc_id", "lang", F.expr(_IDX_ITEM).alias("item"))
    return (items.groupBy("page_id", "lang")
            .agg(F.expr("listagg(item, '') WITHIN GROUP (ORDER BY doc_id)").alias("items"))
            .select("page_id", F.concat(F.lit(PR.index_url + "?lang="), "lang").alias("url"),
                    F.concat(F.lit("<html><body><div class=\"TableOfContents\">toc</div><main>"), "items",
                             F.lit("</main></body></html>")).alias("html")))


@register("i1_index_grouped", f"""
SELECT {_IDX_PAGE} AS page_id, concat('Post ', CAST(doc_id AS VARCHAR)) AS title, {POST_URL} AS url, source AS section
FROM documents WHERE {_BUCKET} % 2 = 1
""")
def i1_index_grouped(spark, sf_dir):
    """Kept links of grouped items, with the title link as section."""
    nodes = _nodes_of(_index_pages(spark, sf_dir))
    return index.index_grouped(nodes, index.locate_index_content(nodes)).select("page_id", "title", "url", "section")


@register("i2_index_by_heading", f"""
SELECT {_IDX_PAGE} AS page_id, title, {POST_URL} AS url, source AS section FROM (
  SELECT *, concat('Post ', CAST(doc_id AS VARCHAR)) AS title FROM documents
  UNION ALL SELECT *, 'Again' FROM documents, range(2) r(i) WHERE doc_id % 7 = 0) x
WHERE {_BUCKET} % 2 = 0
""".replace("SELECT *, 'Again' FROM documents, range(2) r(i)", "SELECT documents.*, 'Again' FROM documents, range(2) r(i)"))
def i2_index_by_heading(spark, sf_dir):
    """Links of lists under the current heading; a nested list gives its
    links again."""
    nodes = _nodes_of(_index_pages(spark, sf_dir))
    return index.index_by_heading(nodes, index.locate_index_content(nodes)).select("page_id", "title", "url", "section")


@register("d14_locate_index_content", f"""
SELECT DISTINCT {_IDX_PAGE} AS page_id, CASE WHEN {_BUCKET} % 2 = 0 THEN 'main' ELSE 'body' END AS tag FROM documents
""")
def d14_locate_index_content(spark, sf_dir):
    """The content element of each index page -- a
    content-class div unless it is a table-of-contents div, else main /
    article / body; the body whenever grouped items exist."""
    nodes = _nodes_of(_index_pages(spark, sf_dir))
    c = index.locate_index_content(nodes)
    tags = dom.elements(nodes).where(F.col("tag").isin("div", "main", "article", "body")).select("page_id", "node_id", "tag")
    return c.join(tags, ["page_id", "node_id"]).select("page_id", "tag")


@register("i4_dedup_keep_first", "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def i4_dedup_keep_first(spark, sf_dir):
    """First document per source in doc_id order (keep-first
    de-duplication by key, partial aggregation)."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return index.dedup_keep_first(d, "source", ["doc_id"], part=None).select("source", "doc_id", "lang")


@register("i3_prefer_first_non_empty", """
SELECT source, doc_id FROM documents WHERE lang = 'en'
UNION ALL
SELECT source, doc_id FROM documents d WHERE lang <> 'en'
  AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source)
""")
def i3_prefer_first_non_empty(spark, sf_dir):
    """Rows of the first alternative (English documents) per
    source; the second alternative (other languages) only for sources
    where the first has none."""
    d = table(spark, sf_dir, "documents")
    a = d.where(F.col("lang") == "en").select("source", "doc_id")
    b = d.where(F.col("lang") != "en").select("source", "doc_id")
    return index.prefer_first_non_empty(a, b, key="source")


@register("p11_class_matches", """
SELECT page_id,
  CAST(len(regexp_extract_all(html, '<[a-z0-9]+ [^>]*class="(?:[^"]* )?ad(?: [^"]*)?"', 0)) AS BIGINT) AS n_exact,
  CAST(len(regexp_extract_all(lower(html), '<[a-z0-9]+ [^>]*class="[^"]*ad[^"]*"', 0)) AS BIGINT) AS n_icontains,
  CAST(len(regexp_extract_all(html, '<[a-z0-9]+ [^>]*class="[^"]*x[^"]*"', 0)) AS BIGINT) AS n_contains_x
FROM pages
""")
def p11_class_matches(spark, sf_dir):
    """The three class-token match modes (exact token,
    case-insensitive substring, case-sensitive substring) counted per
    page over all elements."""
    nodes = page_nodes(spark, sf_dir)
    el = dom.elements(nodes)
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    agg = el.groupBy("page_id").agg(cnt(dom.has_class_token("ad", "exact")).alias("n_exact"),
                                     cnt(dom.has_class_token("AD", "icontains")).alias("n_icontains"),
                                     cnt(dom.has_class_token("x", "contains")).alias("n_contains_x"))
    return table(spark, sf_dir, "pages").select("page_id").join(agg, "page_id", "left").select(
        "page_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_exact", "n_icontains", "n_contains_x")])
