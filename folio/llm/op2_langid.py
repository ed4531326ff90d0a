"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the n-grams (one to ``N`` symbols) that both contain:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). Landmark texts give the Nyström
features, k(x, landmarks) times the inverse square root of the landmarks' own
kernel, and one ridge regression for each language (one versus rest) is solved
on them. Documents are scored in batches: presence matrix times landmark
matrix, then times the folded weights.

Symbols: the ``SYMBOLS`` most frequent letters of the training texts (lower
case), one symbol for any other letter, one for a run of anything else. With so
few symbols an n-gram is a small integer, so the kernel is exact and a text of
any length is one row of presence bits.

Definitions
- Training rows: non-null text and lang, crc32(doc_id as text) mod 5 not 0; of
  each language at most ``PER_LANG`` rows, of which ``LANDMARKS`` (split over
  the languages) are landmarks. lang, source and doc_id are no inputs.
- ``und`` with score 0 for a null text, one without a letter, and if nothing
  can be learned. Ties between languages go to the first by name.
- score: softmax of the regression values (times ``SHARP``), of the predicted
  language. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bounded_sample, id_mod, sliced

#: Bounds of the training sample (documents a language) and of the landmarks.
PER_LANG, LANDMARKS = 500, 256
SYMBOLS, N, RIDGE, SHARP = 60, 3, 1e-3, 8.0
MODULUS, HELD_OUT = 5, 0
_BASE = SYMBOLS + 2  # 0: break, 1..: letters, the last: any other letter
_SIZES = [_BASE ** n for n in range(1, N + 1)]
_STARTS = np.cumsum([0, *_SIZES])


def _letters(text: str) -> str:
    return "".join([c for c in text.lower() if c.isalpha()])


class Symbols:
    """Codes of characters; code points beyond the table are other letters."""

    def __init__(self, alphabet: str) -> None:
        self.table = np.zeros(0x3000, np.int32)
        for cp in range(len(self.table)):
            if chr(cp).isalpha():
                self.table[cp] = _BASE - 1
        for i, c in enumerate(alphabet):
            for form in {c, c.upper()}:
                if len(form) == 1 and ord(form) < len(self.table):
                    self.table[ord(form)] = i + 1

    def grams(self, text: str) -> np.ndarray:
        """The n-grams of a text, as places in the presence vector (repeated)."""
        cp = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
        code = self.table[np.minimum(cp, len(self.table) - 1)]
        far = cp >= len(self.table)
        if far.any():
            code = code.copy()
            code[far] = [(_BASE - 1) * chr(c).isalpha() for c in cp[far].tolist()]
        code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])].astype(np.int64)  # one break for a run
        out, now = [code], code
        for n in range(2, N + 1):
            now = now[:-1] * _BASE + code[n - 1:]
            out.append(now + _STARTS[n - 1])
        return np.concatenate(out)


class Model:
    """``used``: place of each n-gram among those that landmarks have."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        counts = Counter(c for t in texts for c in _letters(t))
        self.alphabet = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS])
        self.langs = sorted(set(langs))
        symbols = Symbols(self.alphabet)
        sets = [np.unique(symbols.grams(t)) for t in texts]
        by = {g: [i for i, x in enumerate(langs) if x == g] for g in self.langs}
        share = max(1, LANDMARKS // len(self.langs))
        marks = [i for g in self.langs for i in by[g][:share]]
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
        self.landmarks = np.zeros((len(marks), len(self.vocabulary)), np.float32)
        for row, i in enumerate(marks):
            self.landmarks[row, np.searchsorted(self.vocabulary, sets[i])] = 1 / np.sqrt(len(sets[i]))
        # training kernel against the landmarks, by the same products as scoring
        k = np.concatenate([self._kernel(sets[a:a + 256]) for a in range(0, len(sets), 256)]).astype(np.float64)
        own = k[marks]
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        z = np.hstack([k @ whiten, np.ones((len(k), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weight = np.array([1 / len(by[g]) for g in langs])  # languages count alike, whatever their rows
        a = z.T * weight
        alpha = np.linalg.solve(a @ z + RIDGE * np.eye(z.shape[1]) * weight.sum() / len(z), a @ y)
        self.fold, self.bias = (whiten @ alpha[:-1]).astype(np.float32), alpha[-1]

    def _kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        bits = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, s in enumerate(sets):
            place = np.minimum(np.searchsorted(self.vocabulary, s), len(self.vocabulary) - 1)
            bits[row, place[self.vocabulary[place] == s]] = 1 / np.sqrt(len(s))
        return bits @ self.landmarks.T


class Scorer:
    """A model with the tables that a task needs."""

    def __init__(self, model: Model) -> None:
        self.model, self.symbols = model, Symbols(model.alphabet)
        self.place = np.full(_STARTS[-1], -1, np.int32)
        self.place[model.vocabulary] = np.arange(len(model.vocabulary))
        self.seen = np.zeros(_STARTS[-1], np.uint8)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Regression values, one row a text and one column a language."""
        m = self.model
        bits = np.zeros((len(texts), len(m.vocabulary) + 1), np.float32)
        norm = np.ones(len(texts), np.float32)
        for row, text in enumerate(texts):
            g = self.symbols.grams(text)
            self.seen[g] = 1
            norm[row] = np.count_nonzero(self.seen)
            self.seen[g] = 0
            bits[row, self.place[g]] = 1  # -1, no landmark's: the last column
        kernel = (bits[:, :-1] @ m.landmarks.T) / np.sqrt(norm)[:, None]
        return kernel @ m.fold + m.bias


def fit(docs: DataFrame) -> Model | None:
    """The model of a bounded sample; its texts come to the driver."""
    own = (docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
           .where(id_mod(F.col("doc_id"), MODULUS) != HELD_OUT))
    ids = bounded_sample(own.select("doc_id", "lang"), "lang", "doc_id", PER_LANG)
    rows = own.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").collect()
    rows = sorted({(r["text"], r["lang"]) for r in rows if any(map(str.isalpha, r["text"]))}, key=lambda x: (hash_of(x[0]), x))
    return Model([t for t, _ in rows], [g for _, g in rows]) if rows else None


def hash_of(text: str) -> int:
    """A fixed order of texts that has nothing to do with what they say."""
    import zlib

    return zlib.crc32(text.encode())


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            for a in range(0, len(own), 256):
                part = own[a:a + 256]
                v = scorer([texts[i] for i in part]).astype(np.float64) * SHARP
                p = np.exp(v - v.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i, b, x in zip(part, best.tolist(), p[np.arange(len(part)), best].tolist()):
                    names[i], scores[i] = model.langs[b], round(x, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return (docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
            .select("doc_id", F.coalesce(id_mod(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"))
