"""Benchmark decontamination by winnowing.

Every window of ``WINDOW - GRAM + 1`` consecutive word 5-grams keeps its least
hash (the last one on ties). Two texts that share ``WINDOW`` consecutive words
share such a window and therefore the gram that it keeps, so joining the kept
grams misses no shared span of that length.

Steps
1. The benchmark's kept grams go, with the words around them, into a table and
   into a bitmap of fixed size. One scan of the documents keeps the grams that
   the bitmap knows; a false hit of the bitmap costs a row and nothing else.
2. Grams of both sides are joined. The benchmark's table is broadcast if its
   counted rows are few; otherwise each gram is dealt to ``SALTS`` parts, so a
   passage of a third of all documents is no single task.
3. A hit is extended to both sides while the words are equal. Each gram carries
   the ``WINDOW - GRAM`` words on either side, which is as far as any window of
   ``WINDOW`` words around it reaches. Spans of ``WINDOW`` words or more count.
4. Items of fewer words than ``WINDOW`` are one window: they are grams of their
   own length with windows of a single gram.

Definitions
- Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z and are
  compared by 64-bit hashes.
- One result row for each row of ``docs``, repeated rows and null ids included.
  Null and empty texts have no words. Rows of one item_id are one item; a null
  item_id is the item ``''``. Items without words have no windows. An empty
  benchmark leaves every document clean. Extra columns are ignored.
- Texts are never cut: a row is handled as a whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.llm.common import bitmap, in_bitmap, saved, sliced

#: Words of a gram and of the shortest span that counts.
GRAM, WINDOW = 5, 10
SIDE = WINDOW - GRAM
#: Words that a gram carries: itself and what any window around it can reach.
CONTEXT = GRAM + 2 * SIDE
#: Benchmark grams that are broadcast at most (about 160 bytes each); more are shuffled.
BROADCAST = 100_000
#: Parts that each gram's rows are dealt to in a shuffle.
SALTS = 8

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def _kept(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the grams that winnowing keeps."""
    at, g = textvec.shingles(row, h, GRAM)
    if len(h) < WINDOW:
        return at[:0], g[:0]
    least = np.zeros(len(h), np.uint64)
    least[at] = g
    start = np.flatnonzero(row[:len(h) - WINDOW + 1] == row[WINDOW - 1:])
    best, place = least[start], start.copy()
    for j in range(1, SIDE + 1):
        lower = least[start + j] <= best
        best, place = np.where(lower, least[start + j], best), np.where(lower, start + j, place)
    place = np.unique(place)
    return place, least[place]


def _around(row: np.ndarray, h: np.ndarray, at: np.ndarray, k: int, none: int) -> pa.Array:
    """Words around the grams at ``at``; ``none`` stands outside of the row. A
    gram of ``k`` < ``WINDOW`` words (a short item) carries itself alone."""
    place = at[:, None] + np.arange(-SIDE if k == WINDOW else 0, CONTEXT - SIDE if k == WINDOW else CONTEXT)
    valid = (place >= 0) & (place < len(h))
    place = np.clip(place, 0, max(len(h) - 1, 0))
    valid &= row[place] == row[at][:, None]
    if k < WINDOW:
        valid[:, k:], none = False, 0
    out = np.where(valid, h[place], np.uint64(none)).view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), CONTEXT).cast(pa.list_(pa.int64()))


def _item_prints(bench: DataFrame) -> DataFrame:
    """(k, fp, around, item): kept grams of the items of ``WINDOW`` words (k =
    ``WINDOW``) and whole shorter items (k = their words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, _, _, h = textvec.words(batch.column("text"), outside=_OUTSIDE)
            n = np.bincount(row, minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows, np.int64)
            for k in range(1, WINDOW + 1):
                if k == WINDOW:
                    at, fp = _kept(row, h)
                else:
                    at, fp = textvec.shingles(row, h, k)
                    whole = n[row[at]] == k
                    at, fp = at[whole], fp[whole]
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), k, np.int32)), pa.array(fp.view(np.int64)), _around(row, h, at, k, 1),
                        batch.column("item").take(pa.array(row[at]))], ["k", "fp", "around", "item"])

    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(run, "k int, fp long, around array<long>, item string").distinct()


def _document_prints(docs: DataFrame, known, lengths: list[int]) -> DataFrame:
    """Rows of two kinds: (row, doc_id, n_words) for each document, and (row,
    k, fp, at, around) for the grams in the bitmap ``known``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_words", "k", "fp", "at", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, next_row = known.value, TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text"):
            ids = batch.column("doc_id")
            row, _, _, h = textvec.words(batch.column("text"), outside=_OUTSIDE)
            m = batch.num_rows
            n = np.bincount(row, minlength=m) if len(row) else np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(next_row + np.arange(m)), ids, pa.array(n.astype(np.int64)), pa.nulls(m, pa.int32()),
                                              *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.list_(pa.int64()))], names)
            start = np.cumsum(n) - n
            for k in lengths:
                at, fp = _kept(row, h) if k == WINDOW else textvec.shingles(row, h, k)
                some = in_bitmap(bits, fp + np.uint64(k))
                at, fp = at[some], fp[some]
                if len(at):
                    own = row[at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(next_row + own), pa.nulls(len(at), ids.type), pa.nulls(len(at), pa.int64()), pa.array(np.full(len(at), k, np.int32)),
                        pa.array(fp.view(np.int64)), pa.array(at - start[own]), _around(row, h, at, k, 0)], names)
            next_row += m

    return docs.select("doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, n_words long, k int, fp long, at long, around array<long>")


def _equal_run(places: list[int]) -> F.Column:
    """How many of ``places``, from the first on, hold equal words."""
    out = F.lit(len(places))
    for n, i in reversed(list(enumerate(places))):
        out = F.when(F.col("around")[i] != F.col("words")[i], n).otherwise(out)
    return out


def _spans(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item, start, end): equal spans of documents and items."""
    items = items.withColumnRenamed("around", "words")
    if items.count() <= BROADCAST:
        met = prints.join(F.broadcast(items), ["k", "fp"])
    else:
        dealt = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = prints.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(dealt, ["k", "fp", "salt"])
    short = F.col("k") < WINDOW
    left = F.when(short, 0).otherwise(_equal_run(list(range(SIDE - 1, -1, -1))))
    right = F.when(short, F.col("k") - GRAM).otherwise(_equal_run(list(range(SIDE + GRAM, CONTEXT))))
    same = F.when(short, F.col("around") == F.col("words")).otherwise(_equal_run(list(range(SIDE, SIDE + GRAM))) == GRAM)
    return (met.where(same).select("row", "item", "k", "at", left.alias("l"), right.alias("r"))
            .where(F.col("l") + GRAM + F.col("r") >= F.col("k"))
            .select("row", "item", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + GRAM + F.col("r")).alias("end")))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each row of ``docs(doc_id,
    text)``: words in spans shared with ``bench(item_id, text)``, those spans
    (start, end; joined where they overlap or touch) and the items' ids as
    sorted strings."""
    spark = docs.sparkSession
    items = saved(_item_prints(bench))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WINDOW numbers
    known = spark.sparkContext.broadcast(bitmap(items.selectExpr("fp + k AS h").distinct()))
    scanned = saved(_document_prints(docs, known, lengths))
    found = _spans(scanned.where("fp IS NOT NULL").select("row", "k", "fp", "at", "around"), items)
    start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))
    closed = lambda a: F.when(a["s"] >= 0, F.concat(a["done"], F.array(F.struct(a["s"].alias("start"), a["e"].alias("end"))))).otherwise(a["done"])
    step = lambda a, x: F.when(x["start"] <= a["e"], F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["end"]).alias("e"))).otherwise(
        F.struct(closed(a).alias("done"), x["start"].alias("s"), x["end"].alias("e")))
    per = (found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"), F.sort_array(F.collect_set("item")).alias("items"))
           .select("row", F.aggregate("all", start, step, closed).alias("spans"), "items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return (scanned.where("fp IS NULL").select("row", "doc_id", "n_words").join(per, "row", "left")
            .select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
