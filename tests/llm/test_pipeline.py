"""The pipeline's stages, each on what its predecessor kept."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.test_llm_operators import blocks_of, components_of, sentence  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_in_order_and_whole(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = kept, corpus_pipeline.common.saved(stage(spark, docs, SF))
        if name != "byte_bpe":
            assert docs.columns == columns
        rows = docs.collect()
        if name == "toxicity":
            gone = {i for i, _ in before} - {r.doc_id for r in rows}
            clean = [i for i in labels if labels[i] == 0]
            assert gone and sum(i in gone for i in clean) <= 0.02 * len(clean)
        elif name == "jaccard_join":
            found = components_of_ids(before)
            assert {r.doc_id for r in rows} == {min(ids) for ids in found}
        elif name == "substring_dedup":
            assert blocks_of(before) and not blocks_of((r.doc_id, r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            texts = dict(before)
            assert rows and all(texts[r.doc_id] == r.text for r in rows)
        else:
            texts, bpe = dict(before), corpus_pipeline.op6_bpe.tokenizer(corpus_pipeline.queries.RANKS)
            assert len(rows) == len(before)
            assert all(bpe.decode(np.array(r.ids, np.int32)).decode() == texts[r.doc_id] for r in rows)
        kept = [(r.doc_id, r.text) for r in rows] if name != "byte_bpe" else kept


def components_of_ids(rows):
    """Groups of doc_ids, by comparing only texts that share a shingle."""
    import re
    from collections import Counter, defaultdict
    sets, at, root = {}, defaultdict(list), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[i] = i
        for s in sets[i]:
            at[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j != i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in sets:
        out[find(i)].append(i)
    return list(out.values())


def test_stages_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, sentence(rng, int(n), 900), "xy"[i % 2], None, None) for i, n in enumerate(rng.integers(0, 90, 12))]
    rows += [(90, None, None, None, None), (91, "", "x", "s", 0), (None, "a b c d e f", None, "s", 3), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.common.saved(stage(spark, now, SF))
        assert now.count() <= frame.count()
    assert components_of([t for _, t, *_ in rows])


def test_near_copies_are_dropped_by_row(spark):
    rng = np.random.default_rng(9)
    a, b, c = (sentence(rng, 40, 9000) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, a), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (None, None), (None, None), (4, "")], key=str)


def test_mixing_emits_every_copy(spark):
    """A hot source and a small one: the output's tokens meet the raked targets."""
    rng = np.random.default_rng(6)
    rows = [(i, sentence(rng, 20, 900), "x", "hot" if i % 20 else "small", None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = {r.doc_id: r.mix_copies for r in corpus_pipeline.op10_raking.mix_documents(docs).collect()}
    got = [r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()]
    assert max(mixed.values()) > 1 and {i: got.count(i) for i in set(got)} == {i: n for i, n in mixed.items() if n}
    share = sum(i % 20 == 0 for i in got) / len(got)
    want = 0.05 ** 0.7 / (0.05 ** 0.7 + 0.95 ** 0.7)
    assert abs(share - want) < 0.02
