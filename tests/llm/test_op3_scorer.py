"""op3: a worker's tasks share one scorer and what it remembers."""

import numpy as np

from folio.llm import op3_toxicity as op


def test_tasks_of_a_model_share_what_was_restored():
    model = (np.ones(64 ** 3, np.float32), {"=bad": 5.0}, -1.0)
    first = op._scorer(model)
    scores = first(["b@d words here", None])
    again = op._scorer(model)
    assert again is first and "b@d" in again.memory
    assert again(["b@d words here", None]) == scores == op.Scorer(model)(["b@d words here", None])
    other = op._scorer((model[0], {}, -1.0))
    assert other is not first and not other.memory


def _in_full(model, text):
    """(score, words) with every token restored and every text searched for spaced letters."""
    channel, low, found = op.Channel(model[0]), text.lower(), {}
    words = [w for token in op._WORD.findall(low) for w in channel.words(token)]
    words += [w for spaced in op._SPACED.findall(low) for w in channel.restore(op._GAP.sub(" ", spaced)).split()]
    for w in words:
        if x := max(model[1].get(f, 0.0) for f in op.features(w)):
            found[w] = x
    total = model[2] - op.CAUTION + sum(sorted(found.values()))
    return round(1 / (1 + np.exp(-max(-30.0, min(30.0, total)))), 6), len(found)


def test_tokens_that_can_weigh_nothing_are_not_restored(monkeypatch):
    counts = np.random.default_rng(5).integers(0, 50, 64 ** 3).astype(np.float32)
    model = (counts, {"=bad": 5.0, "=ab": 2.5, "hor": 3.0, "=horribly": 6.0, "nastin": 4.0, "=\u00e9t\u00e9": 3.0, "aabb": 2.2}, -2.0)
    texts = ["bad b@d, (baad!) b.a.d b a d", "hhorr horrrible,%%% h0rribly", "naasttiin nastiness nastyness nnaassttiinn", "aab ab. aaabbb aabbcc abb",
             "\u00e9\u00e9t\u00e9 \u00e9 t \u00e9 \u03b1\u03b1b \u03b1hor", "b\u00a0a\u00a0d x\x1cy", "y a la b a", "-b -a -d", "1 2 3 B A D", "", "h_o_r r i d"]
    scorer = op.Scorer(model)
    assert list(zip(*scorer(texts))) == [_in_full(model, t) for t in texts]
    scorer = op.Scorer(model)
    monkeypatch.setattr(scorer.channel, "restore", lambda *a: 1 / 0)
    assert scorer(["toolless words, coffee%%% a b"])[1] == [0]


def test_the_scorer_goes_with_the_model():
    model = (np.ones(64 ** 3, np.float32), {"=bad": 5.0}, -1.0)
    op._scorer(model)(["b@d"])
    assert op._KEPT
    del model
    assert not op._KEPT
