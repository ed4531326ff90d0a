"""Line rows of long texts against the operators on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import longtext, markdown

LINES = ["```", "~~~", "  ```py", "~~~~", "# a", "## b c", "#### d", "####### e", "#no", "   # f", "    # g", "", "text", "x `` y", "\u3000```"]


def texts(n=40):
    rng = random.Random(11)
    return [(i, "\n".join(rng.choices(LINES, k=rng.randrange(1, 30)))) for i in range(n)] + [(n, "```"), (n + 1, "a\r\nb\x0bc\n\n")]


def line_rows(spark, docs):
    return markdown.split_lines(docs).withColumn("pos", F.col("pos").cast("bigint"))


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_equal_to_whole_texts_at_every_cut(spark, monkeypatch, block):
    monkeypatch.setattr(longtext, "BLOCK", block)
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    rows = line_rows(spark, docs)
    spans = longtext.fence_spans_of_lines(rows, "doc_id").select("doc_id", "s", F.coalesce("e", F.lit(2147483647)).alias("e"))
    assert sorted(spans.collect()) == sorted(markdown.code_fence_spans(docs).collect())
    demoted = longtext.demote_lines(rows, "doc_id").groupBy("doc_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    assert {r.doc_id: r.text for r in demoted.collect()} == {r.doc_id: r.text for r in markdown.demote_headings(docs).collect()}
    got = longtext.chapter_lines(rows, "doc_id").groupBy("doc_id", "chapter_no").agg(
        F.coalesce(F.max("title"), F.lit("")).alias("title"), F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    want = markdown.split_chapters(docs, level=2)
    assert sorted((r.doc_id, r.chapter_no, r.title, r.text) for r in got.collect()) == sorted((r.doc_id, r.chapter_no, r.title, r.text) for r in want.collect())


def test_files_are_read_in_pieces(spark, tmp_path):
    body = [t for _, t in texts(200)]
    for k in range(2):
        (tmp_path / f"f{k}.md").write_bytes(("\n".join(body[k::2])).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        rows = longtext.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in range(2):
        mine = sorted((r.pos, r.line) for r in rows if r.path.endswith(f"f{k}.md"))
        assert mine == list(enumerate("\n".join(body[k::2]).splitlines()))


def test_null_keys_lines_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 0, "```"), (None, 1, None), (None, 2, "```"), ("a", 0, "# x")], "k string, pos long, line string")
    got = {(r.k, r.pos): r.in_code for r in longtext.fenced_lines(rows, "k").collect()}
    assert got == {(None, 0): True, (None, 1): True, (None, 2): True, ("a", 0): False}
    assert longtext.chapter_lines(rows.limit(0), "k").count() == 0
