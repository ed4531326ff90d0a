"""Quality rules by distribution divergence.

Character classes and common words of a document are compared, as histograms,
with those of its language by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). The references are counted over every document
that passes the base rules.

Definitions
- Words are ``[^\\x20\\x09-\\x0D]+``. word_chars: code points in words. n_symbols:
  characters of ``[#*$%&|<>]``. n_dup_lines: ``\\n``-split lines with a word that
  equal an earlier line. n_repeat_words: words in three-word windows that the
  text has twice or more, all of them counted.
- base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words.
- kept: not base_failed, and no distance over its limit. Guards: characters are
  compared from ``MIN_CHARS`` code points on, words from ``MIN_WORDS`` words on;
  shorter texts pass that comparison (their distance is still returned).
- The common words of a language are its ``TOP`` most frequent (ties by hash);
  all other words are one more cell. A document without a known language is
  compared with every reference and takes the nearest; with no reference at
  all, distances are 0.
- A null or empty text has zero counts and fails the base rules. Rows may
  repeat (each counts); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.llm.common import saved, sliced

TOP = 300
MIN_CHARS, MIN_WORDS = 200, 100
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.55
#: Words a task gathers before it emits their counts.
WINDOW = 4_000_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Character classes: lower, upper, digit, space, line break, stop, other ASCII
#: mark, symbol, lower beyond ASCII, upper beyond ASCII, all else.
CLASSES = 11


def _class_of(cp: int) -> int:
    c = chr(cp)
    if c in "\n\r":
        return 4
    if cp < 128:
        return (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 5 if c in ".,;:'\"-?" else
                7 if c in "#*$%&|<>@=+^~_{}[]\\/" else 6)
    return 9 if c.isupper() else 8 if c.isalpha() else 10


_CLASS = np.array([_class_of(c) for c in range(0x600)], np.int64)


def _measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Base counts and character classes of each row, and its words' hashes."""
    column = pc.fill_null(batch.column("text"), "")
    n = len(column)
    row, a, b, h = textvec.words(column, fold=False)
    raw, ends = textvec.buffer(column)
    at, s = textvec.shingles(row, h, 3)
    # windows that a row has more than once
    o = np.argsort(s)
    r = row[at][o]
    o = o[np.argsort(r.astype(np.uint16) if n <= 65536 else r, kind="stable")]
    s, r = s[o], row[at][o]
    twin = np.zeros(len(s), bool)
    twin[1:] = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
    twin[:-1] |= twin[1:]
    twin_at = at[o[twin]]
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[twin_at + k] = True
    byte_row = np.repeat(np.arange(n), np.diff(ends))
    lead = (raw & 0xC0) != 0x80
    cp = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    kinds = np.where(cp < 0x600, _CLASS[np.minimum(cp, 0x5FF)], 8)
    inside = np.cumsum(np.concatenate([[0], lead & ~textvec._SPACE[raw]]))
    dup = []
    for t in column.to_pylist():
        lines = [x for x in t.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    return {"row": row, "hash": h, "n_words": np.bincount(row, minlength=n), "word_chars": inside[ends[1:]] - inside[ends[:-1]],
            "n_symbols": np.bincount(byte_row[_SYMBOLS[raw]], minlength=n), "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": np.bincount(row[covered], minlength=n),
            "classes": np.bincount(byte_row[lead] * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)}


def _failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, cell, n): sums over all documents that pass the base rules;
    kind 0 for character classes, 1 for words (cell: the word's hash)."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        kinds: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                cell, n = np.unique(np.concatenate(parts), return_counts=True)
                yield batch_of(lang, 1, cell.view(np.int64), n)
            for lang, n in kinds.items():
                yield batch_of(lang, 0, np.arange(CLASSES), n)
            held.clear()
            kinds.clear()

        def batch_of(lang: str, kind: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), kind, np.int32)),
                                               pa.array(cell), pa.array(n.astype(np.int64))], schema=schema)

        for batch in sliced(batches, "text"):
            m = _measure(batch)
            langs, good = np.array(batch.column("lang").to_pylist(), object), ~_failed(m)
            for lang in {x for x in langs[good] if x is not None}:
                own = good & (langs == lang)
                held.setdefault(lang, []).append(m["hash"][own[m["row"]]])
                kinds[lang] = kinds.get(lang, 0) + m["classes"][own].sum(0)
            if sum(len(x) for parts in held.values() for x in parts) > WINDOW:
                yield from flush()
        yield from flush()

    counts = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").mapInArrow(
        run, "lang string, kind int, cell long, n long")
    return counts.groupBy("lang", "kind", "cell").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: shares of character classes, sorted hashes of the
    common words, and their shares with that of all other words last. At most
    ``TOP`` + ``CLASSES`` + 1 rows a language come to the driver."""
    counts = saved(language_counts(docs))  # read three times below
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "cell"))
    top = counts.where("kind = 1").withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "kind", "cell", "n")
    whole = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).select("lang", (F.col("kind") + 2).alias("kind"), F.lit(0).cast("long").alias("cell"), "n")
    got = counts.where("kind = 0").unionByName(top).unionByName(whole).toPandas()
    out = {}
    for lang, rows in got.groupby("lang"):
        of = {k: rows[rows["kind"] == k] for k in (0, 1, 3)}
        chars = np.zeros(CLASSES)
        chars[of[0]["cell"].to_numpy()] = of[0]["n"].to_numpy()
        cell, n = of[1]["cell"].to_numpy(np.int64).view(np.uint64), of[1]["n"].to_numpy(float)
        o = np.argsort(cell)
        total = float(of[3]["n"].sum())
        out[lang] = chars / chars.sum(), cell[o], np.append(n[o], total - n.sum()) / total
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` (counts) to ``q`` (shares);
    0 for rows without counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(d / 2, 0, 1)), 0.0)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in sliced(batches, "text"):
            m, n = _measure(batch), batch.num_rows
            langs = np.array(batch.column("lang").to_pylist(), object)
            chars, words = np.full(n, 2.0), np.full(n, 2.0)
            own = np.array([x in refs for x in langs], bool)
            for lang, (share, cell, common) in refs.items():
                take = np.flatnonzero((langs == lang) | ~own)
                if not len(take):
                    continue
                new = np.full(n, -1)
                new[take] = np.arange(len(take))
                w = new[m["row"]] >= 0
                h = m["hash"][w]
                place = np.minimum(np.searchsorted(cell, h), max(len(cell) - 1, 0))
                place = np.where(cell[place] == h, place, len(cell)) if len(cell) else np.zeros(len(h), np.int64)
                hist = np.bincount(new[m["row"][w]] * (len(cell) + 1) + place, minlength=len(take) * (len(cell) + 1)).reshape(len(take), -1)
                c, d = js_distance(m["classes"][take], share), js_distance(hist, common)
                near = c + d < chars[take] + words[take]
                chars[take[near]], words[take[near]] = c[near], d[near]
            chars[chars > 1], words[words > 1] = 0, 0
            failed = _failed(m)
            kept = (~failed & ((m["classes"].sum(1) < MIN_CHARS) | (chars <= CHAR_LIMIT))
                    & ((m["n_words"] < MIN_WORDS) | (words <= WORD_LIMIT)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(m[c].astype(np.int64)) for c in counts], pa.array(failed),
                 pa.array(np.round(chars, 6)), pa.array(np.round(words, 6)), pa.array(kept)],
                ["doc_id", *counts, "base_failed", "char_distance", "word_distance", "kept"])

    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, char_distance double, word_distance double, kept boolean")
