"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from folio.llm import op12_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    live = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in {(i, tuple(v), y) for i, v, y in live if i % 100 == 0}:
        scored = sorted((-dot(a[1], v), i, y == a[2]) for i, v, y in live if i != a[0])
        for s, p, same in [x for x in scored if x[2]][:5]:
            ns = [(-t, i) for t, i, own in scored if not own and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a[0], p, k + 1, i, -s, t) for k, (t, i) in enumerate(ns)]
    return sorted(out)


def run(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    return sorted(tuple(r) for r in op12_negatives.hard_negatives(df).collect())


def sample(rng, n, dims=12, spread=0.4):
    centres = rng.normal(size=(10, dims))
    out = []
    for k in range(n):
        y = int(rng.integers(10)) if k % 3 else 4  # a hot label
        v = centres[y] + spread * rng.normal(size=dims)
        out.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], y))
    return out


def odd(rows):
    rows = list(rows)
    rows += [rows[200], rows[200], rows[13], rows[13], (13, rows[14][1], 2), (300, rows[5][1], 3)]  # repeats and shared ids
    rows += [(None, rows[0][1], 1), (1000, None, 1), (1100, rows[3][1], None), (1200, [float("nan")] * 12, 1), (1300, [None] * 12, 1), (1400, [float("inf")] * 12, 2)]
    rows += [(1500, [], 3), (1501, [0.0] * 12, 3), (1600, rows[8][1][:5], 4), (-100, rows[9][1], 4), (-7, rows[10][1] + [1.0, 2.0], 9)]
    return rows + [(2000 + k, rows[20][1], rows[20][2]) for k in range(30)]  # ties


@pytest.mark.parametrize("blocks", [(32_768, 8192, 256), (97, 3, 2)])
def test_against_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS", "ANCHORS", "TREE"), blocks):
        monkeypatch.setattr(op12_negatives, name, value)
    monkeypatch.setattr(op12_negatives, "CHUNK", 150)
    rows = odd(sample(np.random.default_rng(4), 700))
    want = brute(rows)
    assert run(spark, rows, ["1 AS g", "2 AS b", "3 AS anchor", "'x' AS v", "4 AS score", "5 AS rank"]) == want
    assert len(want) > 100


def test_bounds_leave_most_scores_unmade_for_near_anchors():
    """Anchors close to each other and candidates far from their windows: the
    tree's bounds settle most scores, and the result is that of all scores."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    anchors = np.floor(256 * (centre + 0.01 * rng.normal(size=(40, 32))))
    rows = np.floor(256 * np.concatenate([rng.normal(size=(3000, 32)), centre + 0.1 * rng.normal(size=(50, 32))]))
    ids, labels = np.arange(40) * 100, np.zeros(40, np.int64)
    row_ids, row_labels = np.arange(len(rows)) * 7 + 3, np.ones(len(rows), np.int64)
    low = int((anchors @ rows[3000:].T).min())
    wanted = [[op12_negatives._Best(10, low, None)] for _ in ids]
    made = op12_negatives._mine(anchors, ids, labels, wanted, False, rows, row_ids, row_labels)
    assert made < 0.2 * len(ids) * len(rows)
    for a, (best,) in zip(anchors, wanted):
        s = rows @ a
        assert [int(x) for x in best.score] == [int(x) for x in sorted(s[s >= low], reverse=True)[:10]]


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(30, 5))
    edges = op12_negatives.spanning_tree(points)
    assert sorted(c for c, _, _ in edges) == list(range(30)) and edges[0][:2] == (0, 0)
    seen = set()
    for child, parent, _ in edges:
        assert child == parent or parent in seen
        seen.add(child)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    group, total = list(range(30)), 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(30) for j in range(i)):
        if group[i] != group[j]:
            total += w
            group = [group[i] if g == group[j] else g for g in group]
    assert math.isclose(total, sum(e for _, _, e in edges))


def test_large_components_are_exact(spark):
    big = [(k * 50, [float(np.float32((2.0 ** 18 + 3 * k) * (1 - k % 2 * 0.4))), float(np.float32(-(2.0 ** 17) + k)), 0.25], k % 2) for k in range(8)]
    assert run(spark, big) == brute(big)
    assert run(spark, big)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(100, [1.0], 1)]) == []
