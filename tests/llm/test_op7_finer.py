"""Keys of passages that aren't near their pivots, against brute force (op7)."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import op7_substrings as op7
from folio.llm import textvec
from folio.llm.common import bitmap, in_bitmap

PLACES = "array<struct<l:int,r:int>>"


def shingles_of(text):
    row, _, _, h = textvec.words(pa.array([text], pa.large_string()))
    return textvec.shingles(row, h, op7.SHINGLE)[1]


def test_prefixes(spark):
    rng = random.Random(5)
    line = rng.choices("abcdefgh", k=70)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randrange(20, 60)) + line[rng.randrange(20):] + rng.choices("xyz", k=rng.randrange(9, 90))) for _ in range(6)]
    texts += ["a b " * 60, "short one", ""]
    rows = []
    for i, text in enumerate(texts):
        top = len(shingles_of(text)) - op7.RUN
        ranges = [sorted(rng.choices(range(top + 1), k=2)) for _ in range(3)] if top >= 0 else []
        rows.append((i, text, ranges, ranges[1:], [(top // 2, top // 2 + op7.WORDS + 3)] if i % 2 and top > 10 else None))
    df = spark.createDataFrame(rows, f"tid long, text string, ws {PLACES}, open {PLACES}, cut array<struct<start:int,end:int>>")
    every, masks = {}, []
    for i, text, ws, open_, cut in rows:
        s = shingles_of(text)
        starts = {x for l, r in ws for x in range(l, r + 1)}
        need = {x for l, r in open_ for x in range(l, r + 1)
                if not any(a - op7.EDGE <= x <= b - op7.WORDS + op7.EDGE for a, b in cut or [])}
        masks.append((s, starts, need))
        for x in starts:
            for h in s[x:x + op7.RUN].view(np.int64).tolist():
                every.setdefault(h, set()).add(i)
    got = op7._prefixes(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted((h, i) for h, ids in every.items() for i in ids)
    counts = got.groupBy("key").agg(F.count("tid").alias("n"))
    words = [bitmap(counts.where(F.col("n") >= n).select("key")) for n in (2, 3, 5)]
    classes = spark.sparkContext.broadcast(words)

    def expected(which, known=None):
        out = set()
        for i, (s, starts, need) in enumerate(masks):
            level = sum(in_bitmap(w, s).astype(int) for w in words) if len(s) else []
            for x in need if which else starts - need:
                first = sorted({(int(level[j]), int(s[j]) >> 2, j2) for j in range(x, x + op7.RUN) for j2 in [int(s[j])]})[:op7.PREFIX]
                out |= {(int(np.uint64(h).view(np.int64)), i) for c, _, h in first if c}
        return {(k, i) for k, i in out if known is None or k in known}

    need = op7._prefixes(df, classes)
    own = {(r.key, r.tid) for r in need.collect()}
    assert own == expected(True) and own
    known = {k for k, _ in own}
    rest = op7._prefixes(df, classes, spark.sparkContext.broadcast(bitmap(need.select("key"))))
    found = {(r.key, r.tid) for r in rest.collect()}
    assert found == expected(False, known) and found
    for r in need.collect():
        s, _, mine = masks[r.tid]
        assert r.l in mine and r.r in mine and np.int64(r.key).view(np.uint64) in s[r.l:r.r + op7.RUN]


def test_near_copies_in_hot_groups(spark):
    """400 texts share 34 words; 50 words around those are near copies in pairs:
    the pairs that brute force finds are found, in a group with no near pivot."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, rows = fresh(34), []
    for i in range(200):
        left, right = fresh(10), fresh(10)
        for j in range(2):
            rows.append(" ".join(fresh(40) + left[:9] + fresh(j) + left[9 + j:] + line + right + fresh(40)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {tuple(sorted((r.doc_id, r.source_doc_id))) for r in op7.repeats(docs).collect()}
    assert len(got & {(k, k + 1) for k in range(0, 400, 2)}) >= 0.95 * 200
