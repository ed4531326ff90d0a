from pyspark.sql import functions as F

from folio.operators import book, incremental, markdown


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_demote_headings(spark):
    src = ["# H\n## S\ntext\n#comment\n#!/bin/bash",
           "```\n# in code\n```\n# out\n~~~\n## tilde\n~~~",
           "   # three\n    # four\n##### five\n###### six\n####### seven"]
    got = {r.doc_id: r.text for r in markdown.demote_headings(docs(spark, src)).collect()}
    assert got[0] == "### H\n#### S\ntext\n#comment\n#!/bin/bash"
    assert got[1] == "```\n# in code\n```\n### out\n~~~\n## tilde\n~~~"
    assert got[2] == "   ### three\n    # four\n###### five\n###### six\n###### seven"


def test_author_list_and_dates(spark):
    posts = spark.createDataFrame([("b", "Zara", "2024-03-01"), ("b", "alice", "2024-01-01"), ("b", "Bob", ""),
                                   ("b", "", "2023-12-31"), ("c", "", "")],
                                  "book_id string, author string, posted_date string")
    a = {r.book_id: r.authors for r in book.author_list(posts, ["book_id"]).collect()}
    assert a == {"b": "alice, Bob, Zara"}
    d = {r.book_id: (r.earliest, r.latest) for r in book.date_range(posts, ["book_id"]).collect()}
    assert d == {"b": ("2023-12-31", "2024-03-01"), "c": ("unknown", "unknown")}


def test_bylines_and_section_breaks(spark):
    posts = spark.createDataFrame([("k", 1, "A", "Bob", "2024-05-10"), ("k", 2, "A", "Alice", ""),
                                   ("k", 3, "", "", "2024-01-01"), ("k", 4, "A", "", ""), ("k", 5, "B", "", "")],
                                  "book_id string, ordinal long, section string, author string, posted_date string")
    r = (book.section_break(posts).select("ordinal", "is_break", book.byline(F.col("author"), F.col("posted_date")).alias("b"))
         .orderBy("ordinal").collect())
    assert [x.is_break for x in r] == [True, False, False, False, True]
    assert [x.b for x in r][:3] == ["*By Bob on 2024-05-10*\n\n", "*By Alice*\n\n", "*2024-01-01*\n\n"]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "url string, markdown string")
    new = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "url string, markdown string")
    got = dict(incremental.snapshot_diff(old, new).collect())
    assert got == {"a": "removed", "b": "same", "c": "changed", "d": "added"}


def test_require_rows(spark):
    import pytest
    with pytest.raises(ValueError):
        book.require_rows(spark.createDataFrame([], "a int"), "No posts found")
