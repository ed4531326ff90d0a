"""Registered document, Markdown and book queries (T1-T3, T11-T13, S10,
S12-S14, A1-A6, W1-W3, T4-T8, K1, U4).

Inputs are ``documents`` and ``conversations`` (whole tables). Markdown
headings and fences do not occur in the given texts, so a stand-in
builder (one shared SQL shape per engine) prefixes lines with heading
marks and inserts fence lines; posts for binding are rows of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import digest
from folio.functions.text import content_hash, iso_date_prefix, typed_date
from folio.operators import book, clean, longtext, markdown
from folio.plans import standins
from folio.plans.catalog import register
from folio.profile import DEFAULT_PROFILE as PR
from folio.sources.pages import table

_LB = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"

# ---------------------------------------------------------------- T1, T11, T13
register("t1_split_lines", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, line FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, CASE WHEN regexp_split_to_array(text, '{_LB}')[-1] = ''
                        THEN regexp_split_to_array(text, '{_LB}')[1:-2]
                        ELSE regexp_split_to_array(text, '{_LB}') END AS l FROM documents))
""")(lambda spark, sf: markdown.split_lines(table(spark, sf, "documents")))

register("t11_drop_license_lines", f"""
SELECT doc_id, COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT regexp_matches(lower(line), 'creative commons|cc by')), '') AS text
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, CASE WHEN regexp_split_to_array(text, '{_LB}')[-1] = ''
                      THEN regexp_split_to_array(text, '{_LB}')[1:-2]
                      ELSE regexp_split_to_array(text, '{_LB}') END AS l FROM documents))
GROUP BY doc_id
UNION ALL
SELECT doc_id, '' FROM documents WHERE text = ''
""")(lambda spark, sf: clean.drop_license_lines(table(spark, sf, "documents")))


@register("t13_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def t13_content_hash(spark, sf):
    """Hex SHA-256 of every document text."""
    return table(spark, sf, "documents").select("doc_id", content_hash("text").alias("content_hash"))


_DATE_SPARK = "CAST(date_add(DATE'2020-01-01', CAST(doc_id % 1000 AS INT)) AS STRING)"
_DATE_DUCK = "CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR)"


@register("t12_iso_date_prefix", f"""
SELECT doc_id, substr({_DATE_DUCK} || 'T08:00:00Z', 1, 10) AS posted_date,
       CAST({_DATE_DUCK} AS DATE) AS posted_date_d FROM documents
""")
def t12_iso_date_prefix(spark, sf):
    """First 10 characters of timestamp text, plus the typed DATE."""
    d = F.concat(F.expr(_DATE_SPARK), F.lit("T08:00:00Z"))
    return table(spark, sf, "documents").select("doc_id", iso_date_prefix(d).alias("posted_date"),
                                                typed_date(d).alias("posted_date_d"))


# ---------------------------------------------------------------- T2, T3, S12, S13
# stand-in Markdown: line i of the text (non-empty lines only) becomes a fence
# line when i % 10 = 4, a heading of 1 + i % 7 hashes when i % 3 = 0, an
# indented level-1 heading when i % 3 = 1, else the line itself
_MD_SPARK = ("array_join(transform(filter(split(text, '\\n'), x -> x != ''), (x, i) -> CASE"
             " WHEN i % 10 = 4 THEN '```' WHEN i % 3 = 0 THEN concat(repeat('#', 1 + i % 7), ' ', x)"
             " WHEN i % 3 = 1 THEN concat('  # ', x) ELSE x END), '\\n')")
_MD_LINES_DUCK = ("list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x, i: CASE"
                  " WHEN (i - 1) % 10 = 4 THEN '```' WHEN (i - 1) % 3 = 0 THEN repeat('#', CAST(1 + (i - 1) % 7 AS INTEGER)) || ' ' || x"
                  " WHEN (i - 1) % 3 = 1 THEN '  # ' || x ELSE x END)")
_MD_ROWS = f"""
  SELECT doc_id, line, CAST(i - 1 AS INTEGER) AS pos,
         count(*) FILTER (WHERE starts_with(ltrim(line), '```')) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences_before,
         starts_with(ltrim(line), '```') AS is_fence
  FROM (SELECT doc_id, unnest({_MD_LINES_DUCK}) AS line, generate_subscripts({_MD_LINES_DUCK}, 1) AS i FROM documents)
"""
_MD_HEAD = f"""
  SELECT *, NOT is_fence AND fences_before % 2 = 0 AND regexp_matches(line, '^( {{0,3}})(#+)( .*)$') AS is_h,
         regexp_extract(line, '^( {{0,3}})(#+)( .*)$', 1) AS indent,
         length(regexp_extract(line, '^( {{0,3}})(#+)( .*)$', 2)) AS n,
         regexp_extract(line, '^( {{0,3}})(#+)( .*)$', 3) AS rest
  FROM ({_MD_ROWS})
"""


def _md_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_MD_SPARK).alias("text"))


register("t3_demote_headings", f"""
SELECT d.doc_id, COALESCE(t.text, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN is_h THEN indent || repeat('#', CAST(least(n + 2, 6) AS INTEGER)) || rest ELSE line END,
                            chr(10) ORDER BY pos) AS text
  FROM ({_MD_HEAD}) GROUP BY doc_id) t ON d.doc_id = t.doc_id
""")(lambda spark, sf: markdown.demote_headings(_md_docs(spark, sf)))

register("t2_code_fence_spans", f"""
SELECT doc_id, s, COALESCE(e, 2147483647) AS e FROM (
  SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ({_MD_ROWS}) WHERE is_fence)
WHERE k % 2 = 1
""")(lambda spark, sf: markdown.code_fence_spans(_md_docs(spark, sf)))

register("s12_toc", f"""
SELECT doc_id, pos, CAST(n AS INTEGER) AS level, trim(rest) AS title FROM ({_MD_HEAD}) WHERE is_h AND n <= 2
""")(lambda spark, sf: markdown.toc(_md_docs(spark, sf), depth=2))

register("s13_split_chapters", f"""
SELECT doc_id, CAST(chapter_no AS INTEGER) AS chapter_no,
       COALESCE(arg_min(CASE WHEN is_h AND n <= 2 THEN trim(rest) END, CASE WHEN is_h AND n <= 2 THEN pos END), '') AS title,
       string_agg(line, chr(10) ORDER BY pos) AS text
FROM (SELECT *, sum(CASE WHEN is_h AND n <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter_no FROM ({_MD_HEAD}))
GROUP BY doc_id, chapter_no
""")(lambda spark, sf: markdown.split_chapters(_md_docs(spark, sf), level=2))


# ---------------------------------------------------------------- posts and books
# posts made from documents: one book per language, ordinal = doc_id
_POSTS_SPARK = {
    "book_id": "lang", "ordinal": "doc_id", "title": "concat('Post ', CAST(doc_id AS STRING))",
    "url": f"concat('{PR.base_url}/posts/', CAST(doc_id AS STRING), '/x')",
    "section": "CASE WHEN doc_id % 6 = 5 THEN '' ELSE source END",
    "author": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(upper(substr(source, 1, 1)), substr(source, 2), CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END) END",
    "posted_date": f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_DATE_SPARK} END",
    "markdown": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END",
}
_POSTS_DUCK = dict(_POSTS_SPARK, posted_date=f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_DATE_DUCK} END",
                   title="'Post ' || CAST(doc_id AS VARCHAR)",
                   url=f"'{PR.base_url}/posts/' || CAST(doc_id AS VARCHAR) || '/x'")
POSTS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _POSTS_DUCK.items()) + " FROM documents)"


def posts_of(spark, sf):
    return table(spark, sf, "documents").select(*[F.expr(v).alias(k) for k, v in _POSTS_SPARK.items()])


register("a1_date_range", f"""
SELECT book_id, COALESCE(min(NULLIF(posted_date, '')), 'unknown') AS earliest,
       COALESCE(max(NULLIF(posted_date, '')), 'unknown') AS latest FROM {POSTS_SQL} GROUP BY book_id
""")(lambda spark, sf: book.date_range(posts_of(spark, sf), ["book_id"]))

_AUTHORS_SQL = f"""(SELECT {{by}}, string_agg(author, ', ' ORDER BY lower(author), author) AS authors
  FROM (SELECT DISTINCT {{by}}, author FROM {POSTS_SQL} WHERE author <> '') GROUP BY {{by}})"""
register("a2_author_list", "SELECT * FROM " + _AUTHORS_SQL.format(by="book_id"))(
    lambda spark, sf: book.author_list(posts_of(spark, sf), ["book_id"]).drop("authors_part"))

# every document its own author: a list that goes over many rows of A2 at scale
register("k1_author_ranks", f"""
SELECT book_id, author, CAST(row_number() OVER (PARTITION BY book_id ORDER BY lower(author), author) AS BIGINT) AS rank FROM (
  SELECT DISTINCT lang AS book_id, substr(md5(text), 1, 12) || CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'A' END AS author FROM documents)
""")(lambda spark, sf: book.author_ranks(table(spark, sf, "documents").select(
    F.col("lang").alias("book_id"), F.expr("concat(substr(md5(text), 1, 12), CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'A' END)").alias("author")),
    ["book_id"]))

register("a3_post_count", f"SELECT book_id, CAST(count(*) AS BIGINT) AS n_posts FROM {POSTS_SQL} GROUP BY book_id")(
    lambda spark, sf: book.post_count(posts_of(spark, sf), ["book_id"]))

# every fourth empty section is NULL instead
_NULL_SECTION = "CASE WHEN section = '' AND ordinal % 4 = 1 THEN NULL ELSE section END"
register("a6_corpus_report", f"""
WITH p AS (SELECT * REPLACE ({_NULL_SECTION} AS section) FROM {POSTS_SQL})
SELECT c.book_id, c.section, n_posts, earliest, latest, COALESCE(a.authors, '') AS authors
FROM (SELECT book_id, section, CAST(count(*) AS BIGINT) AS n_posts, COALESCE(min(NULLIF(posted_date, '')), 'unknown') AS earliest,
             COALESCE(max(NULLIF(posted_date, '')), 'unknown') AS latest FROM p GROUP BY 1, 2) c
LEFT JOIN (SELECT book_id, section, string_agg(author, ', ' ORDER BY lower(author), author) AS authors
           FROM (SELECT DISTINCT book_id, section, author FROM p WHERE author <> '') GROUP BY 1, 2) a
  ON c.book_id IS NOT DISTINCT FROM a.book_id AND c.section IS NOT DISTINCT FROM a.section
""")(lambda spark, sf: book.corpus_report(posts_of(spark, sf).withColumn("section", F.expr(_NULL_SECTION)), ["book_id", "section"])
  .drop("authors_part"))

register("w2_section_break", f"""
SELECT book_id, ordinal, section,
  section <> '' AND COALESCE(section <> last_value(NULLIF(section, '') IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ordinal
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_break
FROM {POSTS_SQL}
""")(lambda spark, sf: book.section_break(posts_of(spark, sf)).select("book_id", "ordinal", "section", "is_break"))

register("w3_position", f"""
SELECT book_id, ordinal, CAST(row_number() OVER (PARTITION BY book_id ORDER BY ordinal) AS BIGINT) AS position,
       CAST(count(*) OVER (PARTITION BY book_id) AS BIGINT) AS total FROM {POSTS_SQL}
""")(lambda spark, sf: book.with_position(posts_of(spark, sf)).select("book_id", "ordinal", "position", "total"))

register("w1_carry_forward", """
SELECT conv_id, turn, role,
       last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS system_text
FROM conversations
""")(lambda spark, sf: book.carry_forward(
    table(spark, sf, "conversations").withColumn("system_text", F.when(F.col("role") == "system", F.col("text"))),
    "system_text", "conv_id", ["turn", "role"]).select("conv_id", "turn", "role", "system_text"))

register("a5_bind_text", """
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role) AS transcript FROM conversations GROUP BY conv_id
""")(lambda spark, sf: book.bind_text(
    table(spark, sf, "conversations").withColumn("said", F.concat("role", F.lit(": "), "text")),
    ["conv_id"], ["turn", "role"], "said", "\\n", "transcript"))

_BYLINE = ("CASE WHEN author <> '' AND posted_date <> '' THEN '*By ' || author || ' on ' || posted_date || '*' || chr(10) || chr(10)"
           " WHEN author <> '' THEN '*By ' || author || '*' || chr(10) || chr(10)"
           " WHEN posted_date <> '' THEN '*' || posted_date || '*' || chr(10) || chr(10) ELSE '' END")
register("t5_byline", f"SELECT book_id, ordinal, {_BYLINE} AS byline FROM {POSTS_SQL}")(
    lambda spark, sf: posts_of(spark, sf).select("book_id", "ordinal", book.byline(F.col("author"), F.col("posted_date")).alias("byline")))

_NL2 = "chr(10) || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _about_sql(posts: str) -> str:
    """The about page of each book, from SQL over ``posts``."""
    label = PR.repo_url.removeprefix("https://")
    return f"""
SELECT r.book_id, '# About This Book' || {_NL2} || 'This book contains blog posts written from ' || earliest || ' to ' || latest || ' by:'
       || {_NL2} || CASE WHEN COALESCE(authors, '') <> '' THEN authors || {_NL2} ELSE '' END || '---' || {_NL2}
       || {_quoted(f"*This ebook was compiled by {PR.compiler_name} using [{label}]({PR.repo_url}). Last text update was on ")} || latest || '.*' || {_NL2} AS text
FROM (SELECT book_id, COALESCE(min(NULLIF(posted_date, '')), 'unknown') AS earliest,
             COALESCE(max(NULLIF(posted_date, '')), 'unknown') AS latest FROM {posts} GROUP BY book_id) r
LEFT JOIN (SELECT book_id, string_agg(author, ', ' ORDER BY lower(author), author) AS authors
           FROM (SELECT DISTINCT book_id, author FROM {posts} WHERE author <> '') GROUP BY book_id) a USING (book_id)"""


# four documents in a row share a URL, so one URL is in several books
_SHARED_SPARK = f"concat('{PR.base_url}/posts/', CAST(ordinal div 4 AS STRING), '/x')"
_SHARED_POSTS = f"(SELECT * REPLACE ('{PR.base_url}/posts/' || CAST(ordinal // 4 AS VARCHAR) || '/x' AS url) FROM {POSTS_SQL})"


def _shared_posts(spark, sf):
    return posts_of(spark, sf).withColumn("url", F.expr(_SHARED_SPARK))


_FRAGMENTS_SQL = f"""
WITH p AS (SELECT *, section <> '' AND COALESCE(section <> last_value(NULLIF(section, '') IGNORE NULLS) OVER (
                PARTITION BY book_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_break
           FROM {_SHARED_POSTS}),
frag AS (
  SELECT book_id, ordinal, 0 AS part, 'section' AS kind, '# ' || section || {_NL2} AS text FROM p WHERE is_break
  UNION ALL SELECT book_id, ordinal, 1, 'heading', '## ' || title || {_NL2} FROM p
  UNION ALL SELECT book_id, ordinal, 2, 'byline', {_BYLINE} FROM p WHERE author <> '' OR posted_date <> ''
  UNION ALL SELECT book_id, ordinal, 3, 'body', CASE WHEN markdown <> '' THEN regexp_replace(markdown, '\\n$', '') || {_NL2}
                                                ELSE '*See original post at: ' || url || '*' || {_NL2} END FROM p
  UNION ALL SELECT book_id, -2, 0, 'about', text FROM ({_about_sql("p")}))
SELECT book_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(part AS INTEGER) AS part, kind, text FROM frag
UNION ALL SELECT DISTINCT book_id, CAST(o AS BIGINT), 0, kind, text FROM p, (VALUES
  (-4, 'front_matter', {_quoted(book.front_matter())}), (-3, 'title', {_quoted(f"# {PR.book_title}")} || {_NL2}),
  (-1, 'toc', '\\tableofcontents' || {_NL2})) v(o, kind, text)
"""
register("t8_bind_book", _FRAGMENTS_SQL)(
    lambda spark, sf: book.bind_book(_shared_posts(spark, sf)).select("book_id", "ordinal", "part", "kind", "text"))

register("t7_about_page", _about_sql(POSTS_SQL))(lambda spark, sf: book.about_page(posts_of(spark, sf)).drop("part"))
register("s9_write_book", f"""
SELECT book_id, line, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT book_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM ({_FRAGMENTS_SQL})) GROUP BY ALL
""")(lambda spark, sf: _write_and_read(spark, sf))


def _write_and_read(spark, sf):
    """Bind the books, write them as ordered text part files under the
    session's checkpoint folder and read their lines back: how often each line
    of a book is there."""
    import uuid
    from folio.session import ensure_checkpoint_dir
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/books-{uuid.uuid4().hex}"
    book.write_book(book.bind_book(_shared_posts(spark, sf)), out)
    lines = spark.read.option("lineSep", "\n").text(out)
    return lines.groupBy("book_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


_ITEM_SQL = "CAST('0x' || substr(md5(line), {at}, 7) AS BIGINT)"
_DIGEST_SQL = " * 2147483648 + ".join(
    f"list_reduce(list({_ITEM_SQL.format(at=at)} ORDER BY ordinal DESC, part DESC, i DESC), lambda a, x: (a * {b} + x) % {digest.PRIME})"
    for at, b in zip((1, 8), digest.BASES))


@register("s9_verify_book", f"""
SELECT book_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes,
       CAST({_DIGEST_SQL} AS BIGINT) AS digest, true AS intact
FROM (SELECT book_id, ordinal, part, unnest(l) AS line, generate_subscripts(l, 1) AS i
      FROM (SELECT book_id, ordinal, part, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM ({_FRAGMENTS_SQL})))
GROUP BY book_id
""")
def s9_verify_book(spark, sf):
    """The books' files, read back by their manifest: size and ordered
    digest of each whole book, and whether the fragments agree."""
    import uuid
    from folio.session import ensure_checkpoint_dir, materialize
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/books-{uuid.uuid4().hex}"
    fragments = materialize(book.bind_book(_shared_posts(spark, sf)))
    book.write_book(fragments, out)
    return book.verify_book(fragments, out)


@register("k4_stable_order", f"""
SELECT book_id, CAST(count(*) AS BIGINT) AS n, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, CAST(0 AS BIGINT) AS descents
FROM {POSTS_SQL} GROUP BY book_id
""")
def k4_stable_order(spark, sf):
    """K4: posts dealt at random, written in index order, and the written files
    checked for it."""
    import uuid
    from folio.session import ensure_checkpoint_dir
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/ordered-{uuid.uuid4().hex}"
    book.write_ordered(posts_of(spark, sf).repartition(F.xxhash64("ordinal")), out, ["book_id", "ordinal"])
    found = book.order_report(spark, out, "book_id", ["book_id", "ordinal"])
    return found.select("book_id", "n", F.col("first.ordinal").alias("first_ordinal"), F.col("last.ordinal").alias("last_ordinal"), "descents")


@register("s14_require_rows", f"SELECT book_id, CAST(count(*) AS BIGINT) AS n_posts FROM {POSTS_SQL} GROUP BY book_id")
def s14_require_rows(spark, sf):
    """The posts table is checked non-empty (one-row probe) before
    binding; per-book counts returned."""
    return book.post_count(book.require_rows(posts_of(spark, sf), "No posts found"), ["book_id"])


@register("s10_read_markdown", f"""
SELECT d.doc_id, COALESCE(t.text, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN is_h THEN indent || repeat('#', CAST(least(n + 2, 6) AS INTEGER)) || rest ELSE line END,
                            chr(10) ORDER BY pos) AS text
  FROM ({_MD_HEAD}) GROUP BY doc_id) t ON d.doc_id = t.doc_id
""")
def s10_read_markdown(spark, sf):
    """Markdown files, one for each document, read back whole and
    heading-demoted (T3) as the convert path does."""
    import uuid
    from folio.session import ensure_checkpoint_dir
    from folio.sources.pages import read_markdown
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/md-{uuid.uuid4().hex}"
    standins.write_files(_md_docs(spark, sf).withColumnRenamed("doc_id", "key"), out, ".md")
    files = read_markdown(spark, out)
    return files.select(F.regexp_extract("path", "/([0-9]+)\\.md$", 1).cast("bigint").alias("doc_id"), markdown.demoted("text").alias("text"))


# all documents of a language as one Markdown text over many part files
_LONG_ROWS = f"""
  SELECT lang AS book_id, line, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, starts_with(ltrim(line), '```') AS is_fence,
         count(*) FILTER (WHERE starts_with(ltrim(line), '```')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences_before
  FROM ({_MD_ROWS}) JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY doc_id, r.pos)
""".replace(f"({_MD_ROWS}) JOIN", f"({_MD_ROWS}) r JOIN")
_LONG_HEAD = _MD_HEAD.replace(_MD_ROWS, _LONG_ROWS)


def _long_lines(spark, sf):
    """The texts, written by S9 and read back as lines."""
    import uuid
    from folio.session import ensure_checkpoint_dir
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/long-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.col("lang").alias("book_id"), F.col("doc_id").alias("ordinal"), F.lit(0).alias("part"),
                                                F.expr(_MD_SPARK).alias("text"))
    book.write_book(docs.where("text <> ''"), out)
    return longtext.read_lines(spark, out, "book_id")


register("t2_long_texts", f"""
SELECT book_id, s, e FROM (
  SELECT book_id, pos AS s, lead(pos) OVER (PARTITION BY book_id ORDER BY pos) AS e,
         row_number() OVER (PARTITION BY book_id ORDER BY pos) AS k FROM ({_LONG_ROWS}) WHERE is_fence)
WHERE k % 2 = 1
""")(lambda spark, sf: longtext.fence_spans_of_lines(_long_lines(spark, sf), "book_id"))

register("t3_long_texts", f"""
SELECT book_id, pos, CASE WHEN is_h THEN indent || repeat('#', CAST(least(n + 2, 6) AS INTEGER)) || rest ELSE line END AS line FROM ({_LONG_HEAD})
""")(lambda spark, sf: longtext.demote_lines(_long_lines(spark, sf), "book_id"))

register("s13_long_texts", f"""
SELECT book_id, CAST(chapter_no AS BIGINT) AS chapter_no, max(title) AS title, CAST(count(*) AS BIGINT) AS n_lines, min(pos) AS first_line
FROM (SELECT *, CASE WHEN is_h AND n <= 2 THEN trim(rest) END AS title,
             sum(CASE WHEN is_h AND n <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter_no FROM ({_LONG_HEAD}))
GROUP BY book_id, chapter_no
""")(lambda spark, sf: longtext.chapter_lines(_long_lines(spark, sf), "book_id").groupBy("book_id", "chapter_no")
     .agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("n_lines"), F.min("pos").alias("first_line")))
