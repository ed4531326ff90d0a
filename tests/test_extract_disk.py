"""What post extraction and the stream leave on disk, and the scopes that rendering keeps."""

import os

from folio.operators import body, clean, dom, posts, render
from folio.plans.catalog import QUERIES
from folio.session import _written

PAGE = "<html><head><meta name='author' content='A'></head><body><div class='postBody'>{}</div></body></html>"
PAGES = "page_id long, url string, html string"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lengths_are_shuffled_not_texts(spark):
    nodes = dom.html_nodes(spark.createDataFrame([(1, "<div>a</div>")], "page_id long, html string"))
    plan = body.largest_div(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "length(text" in plan.split("Exchange hashpartitioning")[-1] or "length(text" in plan
    wide = dom.with_text_offsets(nodes.select("page_id", "node_id", "kind", "text")).select("page_id", "node_id", "text_before", "next_text")
    for part in wide._jdf.queryExecution().optimizedPlan().toString().split("Window")[1:-1]:
        assert "text#" not in part.replace("_text#", "")


def test_scope_and_noise_take_one_exchange(spark):
    nodes = spark.createDataFrame([], "page_id long, node_id int, end_id int, kind string, tag string, classes array<string>, attrs map<string,string>, text string")
    assert _exchanges(clean.drop_noise(clean.scope_nodes(nodes, nodes.select("page_id", "node_id", "end_id")))) == 1


def test_node_table_goes_before_the_rendering(spark):
    before = set(_written)
    found = posts.extract_posts(spark.createDataFrame([(1, "u", PAGE.format("<p>x</p>")), (None, "v", PAGE.format("")), (2, "w", "<p>y</p>")], PAGES))
    kept = [p for p in _written if p not in before]
    tables = [spark.read.parquet(p) for p in kept]
    assert all("_row" not in t.columns for t in tables)
    assert sorted((r.url, r.author, r.markdown, r.rule) for r in found.collect()) == [
        ("u", "A", "x", 1), ("v", "A", "", 1), ("w", "", "*Content could not be extracted from w*", 0)]


def test_phrases_over_pieces_and_empty_scopes(spark):
    rows = ["<p>keep</p><p>Crea<b>tive Com</b>mons</p>", "<p>C</p><p>C</p><p> b</p><p>y now</p>", "", "<br>", "<p>mac</p><p>yes</p>", "<p>CC<i> </i>BY</p>z", "<pre>\n</pre>"]
    nodes = dom.html_nodes(spark.createDataFrame([(i, PAGE.format(h)) for i, h in enumerate(rows)], "page_id long, html string"))
    rw = render.rewrite_nodes(clean.drop_noise(clean.scope_nodes(nodes, body.find_body(nodes))))
    some = render._may_mention(rw.where("kind = 'text'").selectExpr("page_id", "scope_id", "text AS _t"), ["creative commons", "cc by"])
    assert {r.page_id for r in some.collect()} == {0, 1, 4, 5}
    md = {r.page_id: r.markdown for r in render.render_markdown(render.drop_license_blocks(rw)).collect()}
    assert md == {0: "keep", 1: "C\n\nC\n\nb\n\ny now", 2: "", 3: "", 4: "mac\n\nyes", 5: "CC* *BY\n\nz", 6: ""}


def test_a_batch_leaves_no_tables(spark, tmp_path):
    from folio import schemas
    from folio.streaming import refresh
    pages = spark.createDataFrame([(1, "https://forum.example.org/posts/1/x", PAGE.format("<p>x</p>"))], PAGES)
    for f in schemas.PAGES.fieldNames():
        assert f in pages.columns
    pages.write.parquet(f"{tmp_path}/in/a")
    before = set(_written)
    refresh.stream_new_pages(spark, f"{tmp_path}/in/*", f"{tmp_path}/cache", f"{tmp_path}/run", lambda p: posts.cacheable(posts.extract_posts(p)))
    assert set(_written) == before and os.path.isdir(f"{tmp_path}/cache")
