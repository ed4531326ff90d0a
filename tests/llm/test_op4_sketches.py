"""op4: sketches rule out pairs before their sets are made, and no link."""

import numpy as np
import pyarrow as pa

from folio.llm import op4_jaccard as op


def _sketched(sets):
    s = np.concatenate([np.sort(x) for x in sets])
    n = np.array([len(x) for x in sets])
    out = op._sketches(np.repeat(np.arange(len(sets)), n), s, np.concatenate([[0], np.cumsum(n)]))
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in out]


def test_differences_are_no_more_than_those_of_the_sets():
    rng = np.random.default_rng(4)
    for size in (1, 5, 31, 32, 33, 500, 3000):
        base = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
        for gone in (0, 1, len(base) // 7, len(base) // 4):
            more = rng.integers(1, 1 << 63, gone // 2, dtype=np.uint64)
            other = np.unique(np.concatenate([base[gone:], more]))
            x, y = _sketched([base, other])
            assert op._differences(x, y) <= len(np.setxor1d(base, other))
            assert op._differences(x, y) == op._differences(y, x)


def _pairs(spark, sets, ids):
    x = _sketched(sets)
    first = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in enumerate(x)], "cid long, sketch binary")
    return op._likely(spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a, b in ids], "a long, b long, na long, nb long"), first)


def test_unlike_sets_of_one_key_are_ruled_out_by_their_sketches(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(1, 1 << 63, 400, dtype=np.uint64) for _ in range(3)]
    sets[2][:300] = sets[1][:300]  # 300 of 500: no link, but with many in common
    sets += [np.concatenate([sets[0][:343], sets[1][:57]]), np.concatenate([sets[0], sets[1][:133]])]  # 343 of 457 and 400 of 533: links
    ids = [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4)]
    assert sorted((r.a, r.b) for r in _pairs(spark, sets, ids).collect()) == [(0, 3), (0, 4)]


def test_sizes_of_neighbouring_bands_meet_in_the_last_round(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:n]) for n in (300, 301, 340, 399)]  # 296, 297, 336 and 395 shingles
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(docs).collect()}
    assert found == {1: (296, 1), 2: (297, 1), 3: (336, 1), 4: (395, 1)}
    assert pa.types.is_large_binary(op._sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)).type)
