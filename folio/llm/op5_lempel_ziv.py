"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the shortest string that the
parse hasn't met before); the hashes of the phrase set go into a minimum-hash
signature of ``SIZE`` values of 16 bits, written as hex. Two texts compress
alike when they share phrases; the share of equal values estimates the
similarity of their phrase sets.

The contract's edited text keeps the first part of a document, so the parse of
both is one until there. Documents meet their successor by a range partition
of doc_id, sorted inside tasks: each task streams its rows and keeps one
document at hand; only the first and last row of a task need a second step.

Definitions
- A null text is empty. An empty phrase set has the signature of all ones;
  two empty texts are equal (1.0), an empty and another are estimated likewise.
- Equal texts have equal fingerprints. A rest that is a known phrase adds none.
- Next document: by doc_id (null first), then by text; rows that repeat are
  documents of their own; after the last comes the first. A single document is
  its own next. The edited text replaces the last floor(n/4) code points by the
  first as many (or all) of the next document's. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import saved, sliced
from folio.llm.textvec import BASE, INVERSE, mix, powers

SIZE = 64
_rng = np.random.default_rng(5)
_MUL = _rng.integers(1, 1 << 31, (SIZE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, (SIZE, 1), dtype=np.uint32)
#: Phrases hashed at once, which bounds the work array of a long text.
STEP = 4096


def parse(text: str, at: int, known: set[str]) -> tuple[list[int], int]:
    """Parse ``text`` from position ``at`` on with the dictionary ``known``,
    which grows. Returns the phrases' ends and where the unfinished rest (a
    known phrase or nothing) begins. All beginnings of a known phrase are
    known, so the search for its end may start at any length."""
    ends, n, guess = [], len(text), 4
    add, put = known.add, ends.append
    while at < n:
        j = min(n, at + guess)
        p = text[at:j]
        if p in known:
            while p in known and j < n:
                j += 1
                p = text[at:j]
            if p in known:
                break
        else:
            while j > at + 1 and (q := text[at:j - 1]) not in known:
                p, j = q, j - 1
        add(p)
        put(j)
        guess = j - at
        at = j
    return ends, at


def lows(text: str, first: int, ends: list[int]) -> np.ndarray:
    """Minimum of each hash function over the phrases of ``text`` that begin
    at ``first`` and end at ``ends``."""
    out = np.full(SIZE, ~np.uint32(0))
    if not ends:
        return out
    cp = np.frombuffer(text[first:ends[-1]].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    b = np.array(ends) - first
    a = np.concatenate([[0], b[:-1]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(cp) * powers(BASE, len(cp)))])
    h = mix((sums[b] - sums[a]) * powers(INVERSE, len(cp))[a] + (b - a).astype(np.uint64)).astype(np.uint32)
    for k in range(0, len(h), STEP):
        out = np.minimum(out, (_MUL * h[k:k + STEP] + _ADD).min(1))
    return out


def fingerprint(lows: np.ndarray) -> str:
    return mix(lows.astype(np.uint64)).astype(np.uint16).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal values of two fingerprints."""
    return round(sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / SIZE, 6)


def of_text(text: str) -> str:
    return fingerprint(lows(text, 0, parse(text, 0, set())[0]))


def edit(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


class Document:
    """A text's fingerprint, and its parse up to where an edit begins."""

    def __init__(self, text: str) -> None:
        self.text, self.kept = text, len(text) - len(text) // 4
        self.known: set[str] = set()
        ends, self.at = parse(text[:self.kept], 0, self.known)
        self.lows = lows(text, 0, ends)
        self.print = self._with(text)

    def _with(self, whole: str) -> str:
        """Fingerprint of a text that begins with the kept part; the dictionary
        is put back to what it was."""
        ends, _ = parse(whole, self.at, self.known)
        at = self.at
        for end in ends:
            self.known.discard(whole[at:end])
            at = end
        return fingerprint(np.minimum(self.lows, lows(whole, self.at, ends)))

    def edited(self, following: str) -> tuple[str, str]:
        """sha256 and fingerprint of the edited text."""
        whole = edit(self.text, following)
        return hashlib.sha256(whole.encode()).hexdigest(), self._with(whole)


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "task", "head", "tail"]

    def row(doc_id, doc: Document, following: str, following_print: str) -> tuple:
        sha, own = doc.edited(following)
        return (doc_id, len(doc.text), sha, doc.print, own, likeness(doc.print, own), likeness(doc.print, following_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, head, id_type = TaskContext.get().partitionId(), None, None, None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        for batch in sliced(batches, "text"):
            id_type, found = batch.column("doc_id").type, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                doc = held[1] if held and held[1].text == text else Document(text)
                if held:
                    found.append((*row(*held, text, doc.print), None, None, None))
                else:
                    head = text
                held = doc_id, doc
            if found:
                yield batch_of(found)
        if held:  # the first and the last text of the task; the last one's next is in another task
            yield batch_of([(held[0], len(held[1].text), None, held[1].print, None, None, None, task, head, held[1].text)])

    made = saved(ranged.mapInArrow(run, f"doc_id {kind}, {_OUT}, task int, head string, tail string"))
    ends = made.where("task IS NOT NULL")
    order = sorted(r[0] for r in ends.select("task").collect())  # one number a task
    follows = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:] + order[:1])], "task int, next int")
    heads = ends.select(F.col("task").alias("next"), F.col("head").alias("following"))
    last = ends.join(follows, "task").select("doc_id", "tail", "next").join(heads, "next").select("doc_id", "tail", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(i, Document(t), f, of_text(f)) for i, t, f in zip(*[c.to_pylist() for c in batch.columns])]
            if found:
                types = [batch.column("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names[:7])

    return made.where("task IS NULL").select(*names[:7]).unionByName(last.mapInArrow(finish, f"doc_id {kind}, {_OUT}"))
