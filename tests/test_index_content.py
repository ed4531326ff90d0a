"""The content element of a page is one aggregate of numbers, without a sort or a join of its nodes."""

from folio.operators import dom, index


def test_content_is_an_aggregate(spark):
    group = '<div class="LargeSequencesItem-columns">x</div>'
    pages = {
        1: '<body><main>m</main><div class="TableOfContents content">t</div><div class="MainContent"><div class="content">c</div></div></body>',
        2: f'<body class="content"><div class="MainContent">c{group}</div></body>',
        3: "<body><article>a</article><main>m</main><main>n</main></body>",
        4: "<body><article>a</article><article>b</article></body>",
        5: "<html><body><p>p</p></body></html>",
        6: "<p>p</p>",
        7: f"<div class='content'>{group}</div>",  # the parser gives every page a body
    }
    nodes = dom.html_nodes(spark.createDataFrame(list(pages.items()), "page_id long, html string")).cache()
    found = index.locate_index_content(nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Join"))
    own = {(r.page_id, r.node_id): r for r in nodes.where("kind = 'element'").collect()}
    got = {r.page_id: own[r.page_id, r.node_id] for r in found.collect()}
    assert {p: (r.tag, list(r.classes or [])) for p, r in got.items()} == {
        1: ("div", ["MainContent"]), 2: ("body", ["content"]), 3: ("main", []), 4: ("article", []), 5: ("body", []), 6: ("body", []), 7: ("body", [])}
    assert all(r.end_id == own[r.page_id, r.node_id].end_id for r in found.collect())
    first = min(n for (p, n), r in own.items() if p == 3 and r.tag == "main")
    assert got[3].node_id == first
