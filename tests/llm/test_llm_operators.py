"""Each operator against a brute-force form on small tables, and on odd rows:
nulls, empty and very long texts, ties, repeated rows, no rows, extra columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from folio.llm import (op1_quality, op2_langid, op3_toxicity, op4_jaccard, op5_lempel_ziv, op6_bpe, op7_substrings, op8_blocks,
                       op9_snapshots, op10_raking)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, tid string, mix_factor string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = "byte_bpe_multi_50k.tiktoken"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{x}x" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = sentence(rng, 120, 5000)
    near = base.split()
    near[7] = "changed"
    passage = sentence(rng, 60, 5000)
    out = [base, base, " ".join(near), base.upper(), passage, sentence(rng, 80, 5000) + " " + passage + " " + sentence(rng, 70, 5000),
           sentence(rng, 30) + " " + passage, "", None, "   \n ", "one", "one", "two words", "the the the " * 60, "x" * 30_000,
           sentence(rng, 6000, 5000), "çà é ü ß\n\nline\nline\nline\n| a | b $$$", "日本語 テキスト 🙂🙂 " * 20]
    return out + [sentence(rng, int(n), 5000) for n in rng.integers(1, 200, 30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "abcd"[i % 3] if i % 5 else None, "hot" if i % 2 else None, None, "k", "t", "m", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[8]], DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_quality_counts_and_guards(spark, docs, texts):
    got = op1_quality.quality(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] or ""
        w = words(t)
        windows = list(zip(w, w[1:], w[2:]))
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1 and not (r.base_failed and r.kept)
    assert op1_quality.quality(empty(spark)).count() == 0


def test_js_distance_is_the_textbook_one():
    p, q = np.array([[1.0, 3.0], [0, 0]]), np.array([0.5, 0.5])
    m = (p[0] / 4 + q) / 2
    d = 0.5 * sum(x * np.log2(x / y) for x, y in zip(p[0] / 4, m)) + 0.5 * sum(x * np.log2(x / y) for x, y in zip(q, m))
    assert np.allclose(op1_quality.js_distance(p, q), [np.sqrt(d), 0])


def test_language_kernel_matches_sets_and_odd_rows(spark, docs):
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog and the cow", "das haus und der baum"] * 3
    model = op2_langid.Model(texts, ["en", "de"] * 6)
    scorer, symbols = op2_langid.Scorer(model), op2_langid.Symbols(model.alphabet)
    sets = [set(symbols.grams(t).tolist()) for t in texts]
    want = len(sets[0] & sets[1]) / np.sqrt(len(sets[0]) * len(sets[1]))
    assert np.isclose(model._kernel([np.array(sorted(sets[0]))]).max(), 1.0, atol=1e-5)
    assert 0 < want < 1
    assert [model.langs[i] for i in scorer(["the cow and the cat", "die katze und das haus"]).argmax(1)] == ["en", "de"]
    got = op2_langid.identify(docs).collect()
    assert {r.lang_pred for r in got if r.doc_id in (7, 8, 9)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert op2_langid.identify(empty(spark)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op2_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_channel_restores_and_scores(spark, docs):
    sample = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    channel = op3_toxicity.Channel(op3_toxicity.trigram_counts(sample))
    for odd, plain in (("m0r0n", "moron"), ("$cum", "scum"), ("trraaash", "trash"), ("l0$er", "loser"), ("i.d.i.o.t", "idiot")):
        assert plain in channel.words(odd)
    got = op3_toxicity.score(sample, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in op3_toxicity.score(docs, none).collect()} == {0.0}
    assert op3_toxicity.score(empty(spark), labels).count() == 0


def test_channel_decodes_doubled_letters_and_separators(spark):
    sample = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    channel = op3_toxicity.Channel(op3_toxicity.trigram_counts(sample))
    for odd, plain in (("stuupid", "stupid"), ("idiiot", "idiot"), ("scuum", "scum"), ("i--d--i--o--t", "idiot"), ("m...o...r...o...n", "moron")):
        assert plain in channel.words(odd)
    assert "hello" in channel.words("hello") and channel.words("455") == ["ass"] and channel.words("---") == []
    for spaced in ("you i  d  i  o  t now", "you i\nd\ni\no\nt now", "you i. d. i. o. t now"):
        assert "idiot" in channel.text_words(spaced, {})


def test_toxicity_prior_counts_labels_and_near_copies_collapse(spark, monkeypatch):
    rng = np.random.default_rng(12)
    notice = sentence(rng, 12, 9000)
    texts = [(i, sentence(rng, 40, 9000) + (" awful " if i < 60 else " ") + notice) for i in range(400)]
    texts += [(1000 + i, texts[i % 2 * 399][1] + f" tail{i}") for i in range(200)]  # near copies of a toxic and a clean text
    labels = [(i, int(i < 60 or i >= 1000 and i % 2 == 0)) for i, _ in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(op3_toxicity, "CLEAN", 50)
    known = {r.toxic: r["count"] for r in op3_toxicity.usable_labels(docs, frame).groupBy("toxic").count().collect()}
    _, weights, prior = op3_toxicity.fit(docs, frame)
    assert np.isclose(prior, np.log(known[1] / known[0])) and "=awful" in weights or "awf" in weights
    rows = docs.join(frame, "doc_id").selectExpr("xxhash64(text) AS tid", "text", "toxic")
    left = Counter(r.toxic for r in op3_toxicity.collapsed(rows).collect())
    assert left == {1: 60, 0: 340}  # the shared notice joins none, the copies are one with theirs


def components_of(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = words(lower(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard_join_equals_brute_force(spark, docs, texts):
    got = op4_jaccard.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(texts)
    assert op4_jaccard.near_duplicates(empty(spark)).count() == 0


def test_jaccard_join_of_chains_and_hot_shingles(spark):
    rng = np.random.default_rng(8)
    now, rows = sentence(rng, 80, 9000).split(), []
    for i in range(40):  # each text links with its neighbours, few others
        rows.append(" ".join(now))
        now[rng.integers(0, 80)] = f"n{i}"
    line = sentence(rng, 40, 9000)
    rows += [line + " " + sentence(rng, 40, 9000) for _ in range(40)]  # a frequent passage, no links
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard.near_duplicates(docs).collect()}
    assert got == components_of(rows)


def test_lempel_ziv_streams_equal_single_texts(spark, docs, texts):
    rows = sorted([*enumerate(texts), (3, texts[3]), (8, texts[8])], key=lambda x: (x[0], x[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, f = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = op5_lempel_ziv.edit(t, f)
        a, b, c = map(op5_lempel_ziv.of_text, (t, e, f))
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, op5_lempel_ziv.likeness(a, b), op5_lempel_ziv.likeness(a, c))] += 1
    assert Counter(map(tuple, op5_lempel_ziv.fingerprints(docs).collect())) == want
    assert op5_lempel_ziv.fingerprints(empty(spark)).count() == 0
    one = op5_lempel_ziv.fingerprints(docs.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_lempel_ziv_phrases_are_the_shortest_new_ones():
    text, known, at, want = "abababcabcababab aab", set(), 0, []
    for end in range(1, len(text) + 1):
        if text[at:end] not in known:
            known.add(text[at:end])
            want.append(end)
            at = end
    assert op5_lempel_ziv.parse(text, 0, set()) == (want, at)


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, texts):
    import public_tokenizers
    import tiktoken

    bpe = op6_bpe.tokenizer(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = op6_bpe.encode(docs, RANKS).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for odd in ("<|endoftext|>", "a" * 5000, "\x1c\x85  x", "'S 'll don't", "²³½ Ⅷ ٣", "é" * 300, "\r\n \t\n"):
        assert bpe.encode(odd) == encoding.encode_ordinary(odd)
    assert op6_bpe.encode(empty(spark), RANKS).count() == 0


def blocks_of(rows):
    at = {}
    for i, t in rows:
        w = words(lower(t))
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k:k + 50]), set()).add(i)
    return {b: ids for b, ids in at.items() if len(ids) > 1}


def test_substring_dedup_leaves_no_repeat(spark, docs, texts):
    before = list(enumerate(texts))
    kept = op7_substrings.drop_repeats(docs).collect()
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    after = {(r.doc_id, r.text) for r in kept}
    assert blocks_of(before) and not blocks_of(after)
    repeated = {i for ids in blocks_of(before).values() for i in ids}
    assert all((i, t) in after for i, t in before if i not in repeated and i not in (0, 1, 2, 3))
    rows = op7_substrings.repeats(docs).collect()
    assert repeated <= {x for r in rows for x in (r.doc_id, r.source_doc_id)}
    for r in rows:
        assert r.end_word - r.start_word >= 50 and r.doc_id != r.source_doc_id
    assert op7_substrings.drop_repeats(empty(spark)).count() == 0 and op7_substrings.repeats(empty(spark)).count() == 0


def test_substring_dedup_with_misleading_pivots(spark):
    """Many texts share 30 words; some of them share 60 around those."""
    rng = np.random.default_rng(21)
    line, left = sentence(rng, 30, 9000), [sentence(rng, 30, 9000) for _ in range(6)]
    rows = [sentence(rng, 40, 9000) + " " + line + " " + sentence(rng, 40, 9000) for _ in range(30)]
    rows += [sentence(rng, 40, 9000) + " " + left[i % 6] + " " + line + " " + sentence(rng, 40, 9000) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    after = [(r.doc_id, r.text) for r in op7_substrings.drop_repeats(docs).collect()]
    assert blocks_of(enumerate(rows)) and not blocks_of(after)


def test_substring_dedup_finds_edited_passages(spark):
    """Passages of 50 to 120 words with edits at any place, in other contexts,
    against the brute-force similarity of their shingle sets."""
    rng, rows, want = np.random.default_rng(17), [], []
    for i in range(200):
        n = (50, 60, 80, 120)[i % 4]
        one = sentence(rng, n, 9000).split()
        two = list(one)
        for k in range(1 + (n >= 80)):
            two[[n // 2, 2, n - 3, int(rng.integers(n))][(i // 4 + k) % 4]] = f"e{i}e{k}"
        x, y = ({tuple(t[k:k + 5]) for k in range(n - 4)} for t in (one, two))
        if 100 * len(x & y) >= 75 * len(x | y):
            want.append((len(rows), len(rows) + 1))
        rows += [sentence(rng, 100, 9000) + " " + " ".join(t) + " " + sentence(rng, 100, 9000) for t in (one, two)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {tuple(sorted((r.doc_id, r.source_doc_id))) for r in op7_substrings.repeats(docs).collect()}
    assert len(want) > 150 and len(got & set(want)) >= 0.95 * len(want) and all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_substring_dedup_compares_near_copies_beside_the_pivot(spark):
    """Many texts share 38 words; near copies of 50 around those are in pairs of texts."""
    rng = np.random.default_rng(23)
    line = sentence(rng, 38, 9000)
    rows = [sentence(rng, 60, 9000) + " " + line + " " + sentence(rng, 60, 9000) for _ in range(60)]
    for i in range(60):
        own, end = sentence(rng, 6, 9000).split(), sentence(rng, 6, 9000)
        for t in (own, [*own[:2], f"e{i}", *own[3:]]):
            rows.append(sentence(rng, 60, 9000) + " " + " ".join(t) + " " + line + " " + end + " " + sentence(rng, 60, 9000))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {tuple(sorted((r.doc_id, r.source_doc_id))) for r in op7_substrings.repeats(docs).collect()}
    assert len(got & {(k, k + 1) for k in range(60, 180, 2)}) >= 58


@pytest.mark.parametrize("width", [1, 7, 8, 46])
def test_compact_windows_are_the_nodes_of_cartesian_trees(width):
    rng = np.random.default_rng(2)
    sizes = [60, 1, 46, 45, 130, 7]
    v = np.concatenate([rng.integers(1, top, n) for top, n in zip((12, 3, 50, 5, 1000, 2), sizes)]).astype(np.uint64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first, last = (ends - sizes)[text], ends[text] - 1
    got = list(zip(*(x.tolist() for x in op7_substrings.compact_windows(v, first, last, width))))

    def nodes(x, y):  # of the tree over [x, y]
        if y - x + 1 >= width:
            c = x + int(v[x:y + 1].argmin())
            yield max(x, c - width + 1), c, min(y, c + width - 1)
            yield from nodes(x, c - 1)
            yield from nodes(c + 1, y)

    assert got == sorted((n for x, y in zip(ends - sizes, ends - 1) for n in nodes(int(x), int(y))), key=lambda n: n[1])
    for i in range(len(v) - width + 1):
        if text[i] == text[i + width - 1]:
            own = [c for x, c, y in got if x <= i <= c <= i + width - 1 <= y]
            assert len(own) == 1 and v[own[0]] == v[i:i + width].min()


def test_blocks_of_labelled_and_odd_pages(spark):
    tree = op8_blocks.trained()
    for page, labels in op8_blocks.LABELLED:
        texts, x = op8_blocks.blocks(page)
        assert len(texts) == len(labels) and "".join("01"[int(k)] for k in op8_blocks.decide(tree, x)) == labels
    pages = [(0, "u", "<article><p>a&amp;b  c<br>d<p>e &lt;x&gt;<!-- z --><script>'<p>'</script></article><footer>f</footer>"), (0, None, None),
             (1, "u", ""), (2, "u", "<article><p>open <b>x<div class=ad>y</div>" + "<p>long " * 20_000), (3, "u", "<a <b> <!-- never"),
             (4, "u", "<nav><a href='>'>n</a></nav><article><h1>T</h1><section id=comments><p>c</p></section></article>")]
    got = {(r.page_id, r.url): r for r in op8_blocks.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0, "u"].text == "a&b c d\ne <x>" and got[0, None].text == "" and got[1, "u"].n_chars == 0
    assert got[2, "u"].text.startswith("open x\nlong") and got[2, "u"].text.count("\n") == 20_000
    assert got[4, "u"].text == "T"
    assert op8_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_snapshots_collapse(spark):
    talk = [(i % 2, "user" if i % 2 == 0 else "bot", f"t{i}") for i in range(6)]
    rows = [(c, i, talk[i][1], talk[i][2], "x") for c, n in ((1, 2), (2, 4), (3, 6), (4, 6)) for i in range(n)]
    rows += [(5, 0, "user", "t0", "x"), (5, 1, "bot", "else", "x"), (None, 0, None, None, "x"), (6, None, "user", "t", "x"), (2, 0, "user", "t0", "x")]
    rows += [(7, i, "user", f"long {i}", "x") for i in range(300)] + [(8, i, "user", f"long {i}", "x") for i in range(150)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(3)
    got = op9_snapshots.collapse_snapshots(c).collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in got} == {(3, 6, 2), (5, 2, 1), (None, 1, 1), (6, 1, 1), (7, 300, 1)}
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 7), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nlong {i}<|im_end|>\n" for i in range(300))
    assert op9_snapshots.collapse_snapshots(c.limit(0)).count() == 0


def test_raking_meets_its_marginals(spark, docs, texts):
    cells = spark.createDataFrame([(s, g, t, (i * 7919) % 97 + 1) for i, (s, g, t) in enumerate(
        (s, g, t) for s in ("a", None, "c") for g in ("x", "y") for t in ("p", "q"))], "source string, lang string, topic string, tokens long")
    targets = op10_raking.marginal_targets(cells, 0.3)
    want = {(r.dim, r.value): r.target for r in targets.collect()}
    got = op10_raking.rake(cells, targets).toPandas()
    for d in op10_raking.DIMS:
        for v, part in got.groupby(d, dropna=False):
            assert abs(part["weight"].sum() - want[d, None if v != v else v]) < 1e-5
    mixed = op10_raking.mix_documents(docs)
    rows = mixed.collect()
    assert len(rows) == len(texts) + 2 and {r.key for r in rows} == {"k"}
    assert {r.mix_tokens for r in rows if r.doc_id == 8} == {0} and len({r.mix_copies for r in rows if r.doc_id == 3}) == 1
    for r in rows:
        assert r.mix_tokens == len(words(texts[r.doc_id])) and r.mix_copies in (int(r.mix_factor), int(r.mix_factor) + 1)
    assert op10_raking.mix_documents(empty(spark)).count() == 0
