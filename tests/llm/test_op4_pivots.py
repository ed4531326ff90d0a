"""op4: a group of near copies of which few pairs link is joined by pivots, not by all of its pairs."""

import random

import pytest

from folio.llm import op4_jaccard as op


def _groups(texts):
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def test_loose_copies_meet_pivots_of_many_keys(spark, monkeypatch):
    rng, texts = random.Random(7), []
    for i in range(500):
        words = [f"w{k}" for k in range(120)]
        for _ in range(rng.choice((1, 2, 3, 3, 4, 4, 5))):
            words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    tested, likely = [], op._likely

    def counted(pairs, first):
        tested.append(pairs.count())
        return likely(pairs, first)

    monkeypatch.setattr(op, "_likely", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in op.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == _groups(texts)
    assert sum(tested) < 20_000, tested


@pytest.mark.parametrize("more", [[(1, 9), (6, 7)], [(20, 21)], [(2, 6), (1, 6), (30, 2)], []])
def test_new_links_are_followed_over_components(spark, more):
    old = [(1, 2), (2, 3), (5, 6), (8, 9)]
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {tuple(r) for r in op._joined(op.components(links(old)), links(more)).collect()}
    assert got == {tuple(r) for r in op.components(links(old + more)).collect()}
