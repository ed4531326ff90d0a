"""op13: rows of blocks grow with the paths, not with the words they begin with."""

from collections import Counter

import numpy as np

from folio.llm import op13_phrases as op


def test_blocks_hold_every_path_in_few_rows(monkeypatch):
    monkeypatch.setattr(op, "DEALT", 16)
    rng = np.random.default_rng(13)
    blocks, want = op._Blocks(), Counter()
    for lang in ("da", "en"):
        for first in rng.integers(1, 1 << 62, 400, dtype=np.uint64).astype(">u8"):
            for _ in range(2):  # a subtree may leave twice
                rests = sorted({rng.integers(1, 4, k - 1, dtype=np.uint64).astype(">u8").tobytes() for k in (3, 3, 4, 5)})
                counts = rng.integers(1, 9, len(rests)).tolist()
                blocks.add(lang, first.tobytes(), rests, counts)
                want.update({(lang, first.tobytes() + r): n for r, n in zip(rests, counts)})
    assert not list(blocks.take(1 << 40))
    rows = [r for b in blocks.take() for r in b.to_pylist()]
    assert blocks.size == 0 and not list(blocks.take())
    assert len(rows) <= 2 * 3 * 16  # a row a word, length and part before: 2,000 or more
    got, parts = Counter(), {}
    for r in rows:
        width = r["k"] * op.ID
        assert len(r["paths"]) == width * len(r["counts"])
        for i, n in enumerate(r["counts"]):
            path = r["paths"][i * width:(i + 1) * width]
            got[r["lang"], path] += n
            assert parts.setdefault(path, r["part"]) == r["part"]
    assert got == want
    assert len(set(parts.values())) == 16
