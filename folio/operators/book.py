"""Corpus binding and reports.

A book is the ``fragments(book_id, ordinal, part, kind, text)`` table:
constant front parts get negative ordinals, posts keep theirs. The one
Markdown file per book is a sink detail (``write_book``) -- fragments are
written range-partitioned by ordinal, never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import digest
from folio.operators.markdown import demoted
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import materialize


#: Ordinals that one window of W2 and W3 spans; names of a row of A2.
BLOCK = 4096


def _ne(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def date_range(posts: DataFrame, by: list[str]) -> DataFrame:
    """A1: earliest / latest non-empty date string; ``unknown`` when none."""
    return posts.groupBy(*by).agg(F.coalesce(F.min(_ne("posted_date")), F.lit("unknown")).alias("earliest"),
                                  F.coalesce(F.max(_ne("posted_date")), F.lit("unknown")).alias("latest"))


def author_ranks(posts: DataFrame, by: list[str]) -> DataFrame:
    """K1 / U4: ``by, author, rank`` -- the distinct non-empty authors of each
    group with their place (from 1) in case-insensitive order, ties by value.
    The distinct names are sorted in ranges over all tasks; a name's rank is its
    place in its range plus the names that earlier ranges hold of its group, so
    no task or row holds a group."""
    names = posts.where(F.coalesce(F.col("author"), F.lit("")) != "").select(*by, "author").distinct()
    order = [*by, F.lower("author"), F.col("author")]
    ranges = materialize(names.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (ranges.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_first",
                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return ranges.join(sizes, same).select(*by, "author", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("rank"))


def author_list(posts: DataFrame, by: list[str]) -> DataFrame:
    """A2: the authors of ``author_ranks`` joined with ``", "``: a row
    ``by, authors_part, authors`` for each ``BLOCK`` names of a group, so that
    no row grows with a group (one row for a group of up to ``BLOCK``)."""
    ranks = author_ranks(posts, by).withColumn("authors_part", F.floor((F.col("rank") - 1) / BLOCK).cast("int"))
    return ranks.groupBy(*by, "authors_part").agg(F.expr("listagg(author, ', ') WITHIN GROUP (ORDER BY rank)").alias("authors"))


def post_count(posts: DataFrame, by: list[str]) -> DataFrame:
    """A3: number of posts."""
    return posts.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n_posts"))


def corpus_report(posts: DataFrame, by: list[str]) -> DataFrame:
    """A1-A3 per group (e.g. per book and section, or per author); NULL keys
    are groups like any other. A group of more than ``BLOCK`` authors has a row
    for each part of its list (``authors_part``, else 0)."""
    counts = (posts.groupBy(*by)
              .agg(F.count(F.lit(1)).cast("bigint").alias("n_posts"),
                   F.coalesce(F.min(_ne("posted_date")), F.lit("unknown")).alias("earliest"),
                   F.coalesce(F.max(_ne("posted_date")), F.lit("unknown")).alias("latest")))
    names = author_list(posts, by).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return counts.join(names, same, "left").select(*by, "n_posts", "earliest", "latest", F.coalesce("authors_part", F.lit(0)).alias("authors_part"),
                                                   F.coalesce("authors", F.lit("")).alias("authors"))


def _blocked(posts: DataFrame, book: str, *aggs: Column) -> DataFrame:
    """One row for each book and block of ``BLOCK`` ordinals, with ``aggs``."""
    return posts.groupBy(F.col(book).alias("_book"), _block().alias("_at")).agg(*aggs)


def _block() -> Column:
    return F.coalesce(F.floor(F.col("ordinal") / BLOCK), F.lit(-(1 << 60))).cast("bigint")


def _with_carry(posts: DataFrame, book: str, carry: DataFrame) -> DataFrame:
    p = posts.withColumn("_block", _block())
    return (p.join(carry, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_block") == F.col("_at")))
            .drop("_book", "_at"))


def section_break(posts: DataFrame, book: str = "book_id") -> DataFrame:
    """``is_break`` -- a section heading is emitted when the section is
    non-empty and differs from the last emitted one (empty sections do not
    reset; a returning section is emitted again). The last section before a
    block of ordinals is carried between blocks, so no window holds a book."""
    last = F.max_by(_ne("section"), F.when(_ne("section").isNotNull(), F.col("ordinal")))
    before = Window.partitionBy("_book").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carry = _blocked(posts, book, last.alias("_last")).select("_book", "_at", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    w = Window.partitionBy(book, "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.last(_ne("section"), ignorenulls=True).over(w), F.col("_carry"))
    return (_with_carry(posts, book, carry)
            .withColumn("is_break", (F.coalesce(F.col("section"), F.lit("")) != "") & ~F.coalesce(F.col("section") == prev, F.lit(False)))
            .drop("_block", "_carry"))


def with_position(posts: DataFrame, book: str = "book_id") -> DataFrame:
    """1-based position and total per book, from the counts of blocks of
    ordinals and the place inside the block."""
    before = Window.partitionBy("_book").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carry = (_blocked(posts, book, F.count(F.lit(1)).alias("_n"))
             .select("_book", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                     F.sum("_n").over(Window.partitionBy("_book")).cast("bigint").alias("total")))
    w = Window.partitionBy(book, "_block").orderBy("ordinal")
    return (_with_carry(posts, book, carry)
            .withColumn("position", (F.row_number().over(w) + F.col("_before")).cast("bigint")).drop("_block", "_before"))


def bind_text(parts: DataFrame, by: list[str], order: list[str], text: str = "text", sep: str = "", out: str = "text") -> DataFrame:
    """A5: the texts of a group in ``order``, joined by ``sep``. One row holds a
    group: meant for groups of document size (a conversation, a chapter)."""
    sql = f"listagg(`{text}`, '{sep}') WITHIN GROUP (ORDER BY {', '.join(order)})"
    return parts.groupBy(*by).agg(F.coalesce(F.expr(sql), F.lit("")).alias(out))


def carry_forward(df: DataFrame, col: str, part: str, order: str, out: str | None = None) -> DataFrame:
    """The last non-null value of ``col`` up to the current row."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or col, F.last(col, ignorenulls=True).over(w))


def byline(author: Column, date: Column) -> Column:
    """T5: ``*By A on D*`` / ``*By A*`` / ``*D*`` / nothing."""
    a = F.coalesce(author, F.lit(""))
    d = F.coalesce(date, F.lit(""))
    return (F.when((a != "") & (d != ""), F.concat(F.lit("*By "), a, F.lit(" on "), d, F.lit("*\n\n")))
            .when(a != "", F.concat(F.lit("*By "), a, F.lit("*\n\n")))
            .when(d != "", F.concat(F.lit("*"), d, F.lit("*\n\n")))
            .otherwise(F.lit("")))


def about_page(posts: DataFrame, book: str = "book_id", commit_hash: str = "",
               profile: SiteProfile = DEFAULT_PROFILE) -> DataFrame:
    """The about page per book from A1 + A2: ``book, part, text``, one row
    for each part of the author list (a line of up to ``BLOCK`` names). The
    first part has the heading, the last one the attribution."""
    names = author_list(posts, [book])
    ends = names.groupBy(book).agg(F.max("authors_part").alias("_end"))
    rep = (date_range(posts, [book]).join(ends, book, "left").join(names, book, "left")
           .withColumn("part", F.coalesce("authors_part", F.lit(0))))
    first, last = F.col("part") == 0, F.col("part") == F.coalesce("_end", F.lit(0))
    label = profile.repo_url[len("https://"):] if profile.repo_url.startswith("https://") else profile.repo_url
    commit = f" with git commit `{commit_hash}`" if commit_hash else ""
    # ---- fixed values: wording of the about page ----
    head = F.concat(
        F.lit("# About This Book\n\n"),
        F.lit("This book contains blog posts written from "), F.col("earliest"), F.lit(" to "), F.col("latest"),
        F.lit(" by:\n\n"))
    tail = F.concat(
        F.lit("---\n\n"),
        F.lit(f"*This ebook was compiled by {profile.compiler_name} using [{label}]({profile.repo_url}){commit}. "
              "Last text update was on "), F.col("latest"), F.lit(".*\n\n"))
    listed = F.when(F.coalesce(F.col("authors"), F.lit("")) != "", F.concat(F.col("authors"), F.when(last, F.lit("\n\n")).otherwise(F.lit(",\n"))))
    text = F.concat(F.when(first, head).otherwise(F.lit("")), F.coalesce(listed, F.lit("")), F.when(last, tail).otherwise(F.lit("")))
    return rep.select(book, "part", text.alias("text"))


def front_matter(profile: SiteProfile = DEFAULT_PROFILE) -> str:
    # ---- fixed values: front-matter layout of the bound book ----
    return ("---\n"
            f"title: \"{profile.book_title}\"\n"
            f"author: \"{profile.book_author}\"\n"
            f"language: {profile.book_language}\n"
            "description: >\n"
            f"  {profile.book_description}\n"
            "---\n\n")


def bind_book(posts: DataFrame, book: str = "book_id", commit_hash: str = "",
              profile: SiteProfile = DEFAULT_PROFILE, demote_levels: int = 2) -> DataFrame:
    """T8 (with T4-T7, W2, T3): posts -> fragments. Front matter, title
    heading, about page and TOC directive are ordinals -4..-1; each post
    gives parts 0 section heading (on a break), 1 post heading, 2 byline,
    3 body (demoted headings + blank line) or the link to the original."""
    books = posts.select(book).distinct()
    const = [(-4, "front_matter", F.lit(front_matter(profile))),
             (-3, "title", F.lit(f"# {profile.book_title}\n\n")),
             (-1, "toc", F.lit("\\tableofcontents\n\n"))]
    parts = [books.select(book, F.lit(o).cast("long").alias("ordinal"), F.lit(0).alias("part"),
                          F.lit(k).alias("kind"), t.alias("text")) for o, k, t in const]
    parts.append(about_page(posts, book, commit_hash, profile)
                 .select(book, F.lit(-2).cast("long").alias("ordinal"), "part",
                         F.lit("about").alias("kind"), "text"))
    p = section_break(posts, book)
    body = F.when(F.coalesce(F.col("markdown"), F.lit("")) != "", F.concat(demoted("markdown", demote_levels), F.lit("\n\n")))\
        .otherwise(F.concat(F.lit("*See original post at: "), F.col("url"), F.lit("*\n\n")))
    post_parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("section").alias("kind"),
                 F.when(F.col("is_break"), F.concat(F.lit("# "), F.col("section"), F.lit("\n\n"))).alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("heading").alias("kind"),
                 F.concat(F.lit("## "), F.col("title"), F.lit("\n\n")).alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit("byline").alias("kind"), byline(F.col("author"), F.col("posted_date")).alias("text")),
        F.struct(F.lit(3).alias("part"), F.lit("body").alias("kind"), body.alias("text")))
    pp = (p.select(book, F.col("ordinal").cast("long"), F.explode(post_parts).alias("f"))
          .select(book, "ordinal", "f.part", "f.kind", "f.text")
          .where(F.col("text").isNotNull() & (F.col("text") != "")))
    out = pp
    for x in parts:
        out = out.unionByName(x)
    return out


def write_book(fragments: DataFrame, path: str, book: str = "book_id") -> None:
    """Write each book's fragments as UTF-8 text in order, joined with
    no separator: range-partitioned by (book, ordinal, part) and sorted
    within partitions, so the part files read in name order are the
    book. No task ever holds a whole book."""
    # the line separator restores the newline that ends a fragment; one that
    # has none gets it
    (fragments.repartitionByRange(book, "ordinal", "part")
     .sortWithinPartitions(book, "ordinal", "part")
     .select(F.col(book), F.regexp_replace("text", "\n\\z", "").alias("value"))
     .write.mode("overwrite").partitionBy(book).option("lineSep", "\n").text(path))


def book_manifest(spark: SparkSession, path: str, book: str = "book_id") -> DataFrame:
    """What ``write_book`` has written, one row for each part file:
    ``book, file, first_line, lines, bytes, digest``. ``first_line`` counts the
    lines of the files before it; a digest is that of the file's lines in order
    (``digest.ordered``) and merges with its neighbours', so files are read in
    pieces of any size."""
    seen = spark.read.option("lineSep", "\n").text(path).select(
        book, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_piece"),
        digest.place().alias("_at"), digest.item(F.col("value")).alias("_item"), (F.octet_length("value") + 1).alias("_bytes"))
    pieces = digest.pieces(seen, [book, "file", "_piece"], F.sum("_bytes").cast("bigint").alias("bytes"))
    files = digest.merged(pieces, [book, "file"], "_piece", F.sum("bytes").cast("bigint").alias("bytes"))
    before = Window.partitionBy(book).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(book, "file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first_line"),
                        F.col("n").alias("lines"), "bytes", "digest")


def book_digest(manifest: DataFrame, book: str = "book_id") -> DataFrame:
    """``book, lines, bytes, digest`` of whole books, merged from their
    manifest's rows."""
    whole = digest.merged(manifest.withColumnRenamed("lines", "n"), [book], "file", F.sum("bytes").cast("bigint").alias("bytes"))
    return whole.select(book, F.col("n").alias("lines"), "bytes", "digest")


def fragment_digest(fragments: DataFrame, book: str = "book_id") -> DataFrame:
    """``book, lines, bytes, digest`` that the files of ``fragments`` must
    have, from the fragments themselves: what ``verify_book`` compares with."""
    lines = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
    items = F.transform(lines, lambda x: digest.item(x))
    own = F.aggregate(items, digest.empty(), lambda a, x: digest.append(a, x), lambda a: a)
    frags = fragments.select(book, "ordinal", "part", own.alias("_d"), (F.octet_length(F.regexp_replace("text", "\n\\z", "")) + 1).alias("bytes"))
    frags = frags.select(book, "ordinal", "part", _block().alias("_at"), F.col("_d.n").alias("n"), F.col("_d.digest").alias("digest"), "bytes")
    total = F.sum("bytes").cast("bigint").alias("bytes")
    blocks = digest.merged(frags, [book, "_at"], F.struct("ordinal", "part"), total)
    return digest.merged(blocks, [book], "_at", total).select(book, F.col("n").alias("lines"), "bytes", "digest")


def verify_book(fragments: DataFrame, path: str, book: str = "book_id") -> DataFrame:
    """One row per book, ``book, lines, bytes, digest, intact``: whether the
    files under ``path`` hold the lines of ``fragments`` in their order. A book
    of which only one side knows has ``intact`` false."""
    want = fragment_digest(fragments, book).select(F.col(book).cast("string").alias("_book"), F.struct("lines", "bytes", "digest").alias("_want"))
    got = book_digest(book_manifest(fragments.sparkSession, path, book), book).withColumn("_got", F.struct("lines", "bytes", "digest"))
    return (got.join(want, F.col(book).cast("string").eqNullSafe(F.col("_book")), "full")
            .select(F.coalesce(F.col(book).cast("string"), "_book").alias(book), F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"),
                    F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), "digest",
                    F.coalesce(F.col("_got") == F.col("_want"), F.lit(False)).alias("intact")))


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """K4: a Parquet table whose files, read in name order, hold the rows in
    ``order``, whichever task ended first."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def order_report(spark: SparkSession, path: str, by: str, order: list[str]) -> DataFrame:
    """K4: whether a written table is in order: per ``by``, ``n``, its ``first``
    and ``last`` key and ``descents``, the rows whose key is below the row before.
    Inside a piece of a file neighbours are compared (windows of one piece, keys
    only); between pieces the last key of one with the first key of the next.
    Null keys come first, as Spark sorts them; equal keys are in order."""
    key = F.struct(*order)
    rows = spark.read.parquet(path).select(F.col(by).alias("_by"), F.col("_metadata.file_name").alias("_file"),
                                           F.col("_metadata.file_block_start").alias("_piece"), digest.place().alias("_at"), key.alias("_key"))
    w = Window.partitionBy("_by", "_file", "_piece").orderBy("_at")
    down = F.coalesce(F.col("_key") < F.lag("_key").over(w), F.lit(False)).cast("bigint")
    ends = (rows.withColumn("_down", down).groupBy("_by", "_file", "_piece")
            .agg(F.count(F.lit(1)).alias("_n"), F.min_by("_key", "_at").alias("_first"), F.max_by("_key", "_at").alias("_last"), F.sum("_down").alias("_down")))
    across = Window.partitionBy("_by").orderBy("_file", "_piece")
    step = F.coalesce(F.col("_first") < F.lag("_last").over(across), F.lit(False)).cast("bigint")
    place = F.struct("_file", "_piece")
    found = (ends.withColumn("_step", step).groupBy("_by")
             .agg(F.sum("_n").cast("bigint").alias("n"), F.min_by("_first", place).alias("first"),
                  F.max_by("_last", place).alias("last"), F.sum(F.col("_down") + F.col("_step")).cast("bigint").alias("descents")))
    return found.withColumnRenamed("_by", by)


def require_rows(df: DataFrame, message: str = "No posts found") -> DataFrame:
    """Fail fast when a table is empty (one-row probe, not a count)."""
    if df.limit(1).isEmpty():
        raise ValueError(message)
    return df
