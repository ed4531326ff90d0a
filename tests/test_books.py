"""Ordered digests, manifests, order checks and author lists."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import digest
from folio.operators import book


def plain_digest(lines):
    import hashlib
    halves = []
    for at, base in zip((0, 7), digest.BASES):
        items = [int(hashlib.md5(x.encode()).hexdigest()[at:at + 7], 16) for x in lines]
        halves.append(sum(v * pow(base, i, digest.PRIME) for i, v in enumerate(items)) % digest.PRIME)
    return halves[0] * 2**31 + halves[1]


FRAGMENTS = [("a", 1, 0, "one\ntwo\n"), ("a", 1, 1, "\n"), ("a", 2, 0, "three"), ("a", 9000, 0, "ü\n\nfour\n"), ("b", -4, 0, "x\n"), ("b", 7, 0, "")]


def fragments(spark, rows=FRAGMENTS):
    return spark.createDataFrame(rows, "book_id string, ordinal long, part int, text string")


def test_digests_of_books(spark, tmp_path):
    out = str(tmp_path / "books")
    book.write_book(fragments(spark), out)
    want = {"a": ["one", "two", "", "three", "ü", "", "four"], "b": ["x", ""]}
    rows = {r.book_id: r for r in book.verify_book(fragments(spark), out).collect()}
    assert set(rows) == set(want)
    for k, lines in want.items():
        assert (rows[k].lines, rows[k].bytes, rows[k].digest) == (len(lines), sum(len(x.encode()) + 1 for x in lines), plain_digest(lines))
        assert rows[k].intact


@pytest.mark.parametrize("change", [
    lambda rows: [rows[2][:3] + (rows[0][3],), *rows[1:2], rows[0][:3] + (rows[2][3],), *rows[3:]],  # two texts change places
    lambda rows: rows[:-1] + [("c", 1, 0, "new\n")],
    lambda rows: rows[1:],
])
def test_changed_books_are_found(spark, tmp_path, change):
    out = str(tmp_path / "books")
    book.write_book(fragments(spark), out)
    found = book.verify_book(fragments(spark, change(list(FRAGMENTS))), out).collect()
    assert any(not r.intact for r in found)


def test_manifest_merges_files_cut_in_pieces(spark, tmp_path):
    rng = random.Random(5)
    lines = ["".join(rng.choices("abc ", k=rng.randrange(40))) for _ in range(3000)]
    out = str(tmp_path / "books")
    frags = spark.createDataFrame([("a", i, 0, x + "\n") for i, x in enumerate(lines)], "book_id string, ordinal long, part int, text string")
    book.write_book(frags, out)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        manifest = book.book_manifest(spark, out).orderBy("file").collect()
        whole = book.book_digest(book.book_manifest(spark, out)).collect()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [m.first_line for m in manifest] == [sum(m.lines for m in manifest[:k]) for k in range(len(manifest))]
    assert (whole.lines, whole.digest) == (3000, plain_digest(lines))
    assert book.verify_book(frags, out).where("intact").count() == 1


def test_no_fragments(spark, tmp_path):
    assert book.fragment_digest(fragments(spark, [])).count() == 0


def test_order_report(spark, tmp_path):
    df = spark.createDataFrame([(b, i) for b in ("x", None) for i in [*range(200), None]], "b string, i long")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    book.write_ordered(df, good, ["b", "i"])
    df.orderBy(F.desc("i")).coalesce(1).write.parquet(bad)
    got = {r.b: r for r in book.order_report(spark, good, "b", ["i"]).collect()}
    assert {k: (r.n, r.first.i, r.last.i, r.descents) for k, r in got.items()} == {"x": (201, None, 199, 0), None: (201, None, 199, 0)}
    assert all(r.descents > 0 for r in book.order_report(spark, bad, "b", ["i"]).collect())


def author_posts(spark, rows):
    return spark.createDataFrame(rows, "book_id string, author string, posted_date string")


def by_name(names):
    return sorted({n for n in names if n}, key=lambda n: (n.lower(), n))


def test_author_ranks_and_parts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["", None, *("".join(rng.choices("abAB", k=3)) for _ in range(6))]), "2020-01-01") for _ in range(600)]
    want = {k: by_name(n for b, n, _ in rows if b == k) for k in ("a", "b", None)}
    ranks = book.author_ranks(author_posts(spark, rows), ["book_id"]).collect()
    assert sorted((str(r.book_id), r["rank"], r.author) for r in ranks) == sorted((str(k), i + 1, n) for k, v in want.items() for i, n in enumerate(v))
    monkeypatch.setattr(book, "BLOCK", 7)
    parts = book.author_list(author_posts(spark, rows), ["book_id"]).collect()
    for k, names in want.items():
        mine = sorted((r for r in parts if r.book_id == k), key=lambda r: r.authors_part)
        assert [r.authors for r in mine] == [", ".join(names[i:i + 7]) for i in range(0, len(names), 7)]
    report = book.corpus_report(author_posts(spark, rows), ["book_id"]).collect()
    for k, names in want.items():
        mine = sorted((r for r in report if r.book_id == k), key=lambda r: r.authors_part)
        assert {r.n_posts for r in mine} == {sum(b == k for b, _, _ in rows)} and ", ".join(r.authors for r in mine) == ", ".join(names)


def test_about_page_of_many_authors(spark, monkeypatch):
    rows = [("a", f"n{i:02d}", "2020-01-01") for i in range(20)] + [("b", "", "")]
    whole = {r.book_id: r.text for r in book.about_page(author_posts(spark, rows)).collect()}
    monkeypatch.setattr(book, "BLOCK", 8)
    cut = sorted((r for r in book.about_page(author_posts(spark, rows)).collect() if r.book_id == "a"), key=lambda r: r.part)
    assert [r.part for r in cut] == [0, 1, 2]
    assert "".join(r.text for r in cut).replace(",\n", ", ") == whole["a"]
    assert "unknown to unknown by:\n\n---" in whole["b"]


def test_no_authors(spark):
    assert book.author_list(author_posts(spark, [("a", None, None)]), ["book_id"]).count() == 0
    assert [r.authors for r in book.corpus_report(author_posts(spark, [("a", None, None)]), ["book_id"]).collect()] == [""]
