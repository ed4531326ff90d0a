"""Rows without a link take no part in the links' join; licence phrases are plain text."""

from dataclasses import replace

from folio.operators import body, clean, dom, render
from folio.profile import DEFAULT_PROFILE

PAGE = ('<div class="postBody"><p>See <a href="/a">one</a> <a href="javascript:x">two</a><img src="data:x" alt="i"></p>'
        "<p>All rights (C)+ us.</p><p>end</p></div>")


def _rewritten(spark, profile):
    nodes = dom.html_nodes(spark.createDataFrame([(1, PAGE), (2, PAGE)], "page_id long, html string"))
    return render.rewrite_nodes(clean.scope_nodes(nodes, body.find_body(nodes)), profile)


def test_only_links_are_joined(spark):
    rw = _rewritten(spark, DEFAULT_PROFILE)
    plan = rw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
    rows = [(r.page_id, r.tag, r.href, r.src) for r in rw.where("tag IN ('a', 'img')").collect()]
    one = [("a", None, None), ("a", DEFAULT_PROFILE.base_url + "/a", None), ("img", None, None)]
    assert sorted(rows, key=str) == sorted([(p, *x) for p in (1, 2) for x in one], key=str)
    assert rw.where("kind = 'text'").count() == 2 * 6


def test_licence_phrases_are_no_patterns(spark):
    profile = replace(DEFAULT_PROFILE, license_phrases=("rights (c)+",))
    md = render.render_markdown(render.drop_license_blocks(_rewritten(spark, profile), profile))
    assert {("rights" in r.markdown, r.markdown.endswith("end")) for r in md.collect()} == {(False, True)}
