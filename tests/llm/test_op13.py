"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from folio.llm import op13_phrases


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    out = []
    name = lambda x: "und" if x is None else x
    for lang in {name(d[1]) for d in docs}:
        f = Counter()
        for text, own in docs:
            if name(own) == lang:
                for w in pieces(text):
                    f.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, ph.decode(), -a, l, r, n, -s) for i, (s, a, ph, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def run(spark, docs, top, extra=()):
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", *extra).repartition(3)
    return sorted(tuple(r) for r in op13_phrases.collocations(df, top).collect())


@pytest.fixture(scope="module")
def docs():
    """Skewed words, set phrases, repeats, marks between words, odd rows."""
    rng = random.Random(11)
    vocab = ["the", "The", "of", "über", "naïve", "日本", "x-y", "'s", "#", "a b", "q", "z"]
    fixed = ["new york city hall", "of the of the of", "in spite of", "über alles naïve one two"]
    out = []
    for k in range(250):
        w = [rng.choice(vocab) if rng.random() < 0.6 else rng.choice(fixed) for _ in range(rng.randint(1, 30))]
        out.append((rng.choice([" ", "  ", "\t"]).join(w).replace(" q", rng.choice([",", ". ", "\n", " q", "\x0b", ";q"])), rng.choice(["en", "en", "de", None, "und"])))
    return out + [out[0], out[0], ("", "en"), (None, "en"), (None, None), (" ,. ", "xx"), ("the " * 5000, "long"), ("word", "")]


@pytest.mark.parametrize("least,top", [(20, 2000), (7, 10)])
def test_against_brute_force(spark, monkeypatch, docs, least, top):
    monkeypatch.setattr(op13_phrases, "LEAST", least)
    got = run(spark, docs, top, ["1 AS id", "2 AS n", "'w' AS word", "3 AS path", "4 AS size", "5 AS score", "6 AS prefix"])
    assert got == brute(docs, least, top)
    assert len(got) > 30


def test_spills_and_bursts_change_nothing(spark, monkeypatch, docs):
    for name, value in (("LEAST", 5), ("BURST", 4), ("LIMIT", 50), ("GATHER", 40), ("OUT", 20)):
        monkeypatch.setattr(op13_phrases, name, value)
    assert run(spark, docs, 2000) == brute(docs, 5, 2000)


def test_trie_keeps_sorted_runs_and_sizes(monkeypatch):
    monkeypatch.setattr(op13_phrases, "BURST", 8)
    rng = random.Random(2)
    trie, want, out = op13_phrases.HatTrie(), Counter(), Counter()
    ids = [rng.randbytes(8) for _ in range(6)]
    for _ in range(400):
        first = rng.choice(ids)
        rests = list({b"".join(rng.choices(ids, k=rng.randint(2, 4))) for _ in range(5)})
        counts = [rng.randint(1, 9) for _ in rests]
        trie.add(first, rests, counts)
        want.update({first + r: n for r, n in zip(rests, counts)})
        if trie.size > 300:
            for first, rests, n in trie.spill(trie.size // 2):
                assert rests == sorted(rests) and first not in trie.child  # whole subtrees
                out.update({first + r: x for r, x in zip(rests, n)})
    assert any(isinstance(x, op13_phrases.HatTrie) for x in trie.child.values())
    paths, counts = trie.run()
    assert paths == sorted(paths) and len(paths) == trie.size
    out.update(dict(zip(paths, counts)))
    assert out == want


def test_no_rows_and_big_counts(spark):
    assert run(spark, [], 10) == []
    big = 3 * 10 ** 15
    got = spark.sql(f"SELECT (CAST(1000 * CAST({big} AS decimal(17, 0)) AS decimal(20, 0)) * CAST({big * 9} AS decimal(17, 0)))"
                    f" div (CAST({big + 1} AS decimal(19, 0)) * CAST({big + 7} AS decimal(19, 0))) AS s").first()["s"]
    assert got == 1000 * big * big * 9 // ((big + 1) * (big + 7))
