"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from folio.llm import op11_winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = [(str(i) if i is not None else "", w[k:k + 10]) for i, t in items for w in [words(t)] for k in range(max(len(w) - 9, 1)) if w]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def run(spark, docs, items, extra=""):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *(extra.split(", ") if extra else []))
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *(extra.split(", ") if extra else []))
    got = op11_winnowing.decontaminate(d, b).collect()
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(e - s for s, e in spans) == r["n_hit"]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str)


@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    """Small vocabulary, so that spans of every length near ten words, ties of
    hashes and repeats inside a text are common; both kinds of join."""
    monkeypatch.setattr(op11_winnowing, "BROADCAST", broadcast)
    rng = random.Random(3)
    vocab = ["Über", "ab", "c1", "dé", "E", "f", "gg", "h", "日本"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([9, 10, 11, 14, 30])))) for k in range(25)]
    items += [(100, "ab ab ab ab ab ab ab ab ab ab ab ab ab"), (101, "one-off, two"), (102, "solo"), (103, ""), (104, None), (3, "twelve " * 12), (None, "x y z " * 4)]
    docs = []
    for k in range(60):
        w = say(rng.randint(0, 40))
        if k % 2:
            t = words(items[rng.randrange(25)][1])
            a = rng.randrange(len(t))
            w[rng.randint(0, len(w)):0] = t[a:a + rng.randint(7, 15)]
        docs.append((k // 2, rng.choice([" ", "-", " | "]).join(w)))
    docs += [(900, "AB " * 25), (901, "say solo; one off two"), (902, ""), (903, None), (None, "twelve " * 11), (904, "x y z x y z x y z x"), (904, "x y z x y z x y z x")]
    assert run(spark, docs, items) == brute(docs, items)


def test_every_shared_span_of_ten_words_is_found(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    docs = []
    for a in range(0, 380, 3):
        n = rng.choice([9, 10, 11])
        docs.append((a, " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(20)) + " " + " ".join(base[a:a + n]) + " tail"))
    got = run(spark, docs, [(1, " ".join(base))])
    assert got == brute(docs, [(1, " ".join(base))])
    assert {r[2] for r in got} == {0, 10, 11}


def test_no_rows_and_clashing_columns(spark):
    docs = [(1, "a b c d e f g h i j k"), (2, None)]
    extra = "1 AS row, 2 AS k, 3 AS fp, 'x' AS item, 4 AS at, 5 AS salt, 6 AS words, 7 AS around"
    assert run(spark, docs, [], "1 AS row, 'x' AS item") == [(1, 11, 0, []), (2, 0, 0, [])]
    assert run(spark, [], [(1, docs[0][1])], "1 AS fp, 2 AS salt") == []
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *extra.split(", "))
    b = spark.createDataFrame([(7, "B C D E F G H I J K")], "item_id long, text string").selectExpr("*", *extra.split(", "))
    got = op11_winnowing.decontaminate(d, b).collect()
    assert {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in got} == {(1, 10, ("7",)), (2, 0, ())}


def test_hot_passage_and_long_text(spark):
    """A passage that every document and several items have, and a text of 200,000 words."""
    passage = " ".join(f"p{k}" for k in range(15))
    docs = [(k, f"d{k} {passage} e{k}") for k in range(300)] + [(999, " ".join(f"l{k}" for k in range(200_000)) + " " + passage)]
    items = [(k, f"i{k} {passage}") for k in range(20)]
    got = run(spark, docs, items)
    assert all(r[2] == 15 and len(r[3]) == 20 for r in got) and len(got) == 301
