"""The event sweep of J4 and D2-D5 against interval tests on random trees."""

import random

from folio.operators import clean, dom

NODE = "page_id long, node_id int, end_id int, kind string, tag string, classes array<string>, attrs map<string,string>, text string"


def tree(rng, page, n):
    """(page, node, end) of a random tree in pre-order."""
    end, stack, rows = [0] * n, [0], []
    for k in range(1, n):
        while len(stack) > 1 and rng.random() < 0.45:
            end[stack.pop()] = k - 1
        stack.append(k)
    for k in stack:
        end[k] = n - 1
    for k in range(n):
        rows.append((page, k, end[k], "element", rng.choice(["nav", "div", "p", "a"]), ["Comments"] if rng.random() < 0.1 else [],
                     {"aria-hidden": "true"} if rng.random() < 0.1 else {}, None))
    return rows


def test_containment_and_removal(spark):
    rng = random.Random(7)
    rows = [r for page in range(12) for r in tree(rng, page, rng.choice([1, 5, 60]))]
    marks = [r for r in rows if rng.random() < 0.25]
    marks += marks[:2]  # a repeated subtree
    nodes = spark.createDataFrame(rows, NODE).repartition(4)
    anc = spark.createDataFrame([(p, i, e, f"m{i}") for p, i, e, *_ in marks], "page_id long, node_id int, end_id int, name string")
    for own in (True, False):
        want = sorted((p, i, a) for p, i, *_ in rows for q, a, e, *_ in marks if p == q and (a <= i if own else a < i) and i <= e)
        got = sorted((r.page_id, r.node_id, r.anc_node_id) for r in dom.descendants_of(nodes, anc, include_self=own).collect())
        assert got == want
        inside = {(p, i) for p, i, _ in want}
        assert sorted((r.page_id, r.node_id) for r in dom.descendants_of(nodes, anc, "left_semi", own).collect()) == sorted(inside)
        assert sorted((r.page_id, r.node_id) for r in dom.descendants_of(nodes, anc, "left_anti", own).collect()) == sorted({r[:2] for r in rows} - inside)
    scoped = clean.scope_nodes(nodes, anc.drop("name").distinct())
    bad = [r for r in rows if r[4] == "nav" or r[6] or (r[4] == "div" and r[5])]
    want = sorted((p, a, i) for p, i, *_ in rows for q, a, e, *_ in set((m[0], m[1], m[2]) for m in marks) if p == q and a <= i <= e
                  and not any(x[0] == p and a < x[1] <= i <= x[2] for x in bad))
    assert sorted((r.page_id, r.scope_id, r.node_id) for r in clean.drop_noise(scoped).collect()) == want


def test_plans_hold_no_range_join(spark):
    nodes = spark.createDataFrame(tree(random.Random(1), 1, 9), NODE)
    anc = nodes.select("page_id", "node_id", "end_id")
    for df in (dom.descendants_of(nodes, anc), clean.drop_noise(clean.scope_nodes(nodes, anc))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_page_of_many_links_and_subtrees(spark):
    """20,000 lists with a link each below one list: the pairs are those of the result, not lists x links."""
    n = 20_000
    rows = [(1, 0, 2 * n)] + [(1, 2 * k + 1, 2 * k + 2) for k in range(n)]
    lists = spark.createDataFrame(rows, "page_id long, node_id int, end_id int")
    links = spark.createDataFrame([(1, 2 * k + 2, 2 * k + 2) for k in range(n)], "page_id long, node_id int, end_id int")
    assert dom.descendants_of(links, lists, include_self=False).count() == 2 * n
