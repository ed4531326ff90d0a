"""Passages that say one word again and again (op7)."""

import numpy as np
from pyspark.sql import functions as F

from folio.llm import op7_substrings as op7

PLACES = "array<struct<l:int,r:int>>"


def _text(i, n, tail=60):
    own = lambda k: " ".join(f"w{i}x{j}" for j in range(k, k + tail))
    return f"{own(0)} and and and and and and {own(100)} {'and ' * n}{own(200)}"


def test_runs_are_repeats_wherever_they_are():
    """A run that is in the midst of both texts, after a shorter one."""
    hashes = lambda i, n: np.array([hash((i, j)) for j in range(60)] + [7, 7] + [hash((i, j, 1)) for j in range(60)] + [7] * n
                                   + [hash((i, j, 2)) for j in range(60)], np.int64)
    a, b = hashes(1, 90), hashes(2, 70)
    order = op7._by_run(b)
    place = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    found = op7._near(a, b, b[order][place] == a, order[place])
    assert found and found[0][0] == 122 and found[0][1] == 212 and set(b[found[0][2]:found[0][3]].tolist()) == {7}


def test_runs_go_with_their_pivot(spark, monkeypatch):
    """Texts with a run of one word meet their pivot, not each other."""
    pairs, verify = [], op7._verify
    monkeypatch.setattr(op7, "_verify", lambda some: pairs.append(some.count()) or verify(some))
    docs = spark.createDataFrame([(i, _text(i, 60 + i % 30)) for i in range(60)], "doc_id long, text string").repartition(4)
    found = {r.doc_id for r in op7.repeats(docs).collect()}
    assert len(found) == 59 and sum(pairs) < 5 * 60


def test_few_distinct_shingles_have_few_keys(spark):
    texts = [_text(0, 100), _text(1, 100)]
    df = spark.createDataFrame([(i, t, [(0, 150)], [(0, 150)], None) for i, t in enumerate(texts)],
                               f"tid long, text string, ws {PLACES}, open {PLACES}, cut array<struct<start:int,end:int>>")
    counts = op7._prefixes(df).groupBy("key").agg(F.count("tid").alias("n"))
    classes = spark.sparkContext.broadcast([op7.bitmap(counts.where(F.col("n") >= n).select("key")) for n in (2, 3, 4)])
    every, few = (op7._prefixes(df, classes, similar=x).groupBy("tid").agg(F.min("l")).collect() for x in (False, True))
    assert {r[1] for r in every} < {r[1] for r in few} or min(r[1] for r in few) > min(r[1] for r in every)
