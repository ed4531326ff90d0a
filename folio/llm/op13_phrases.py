"""Phrase collocation mining with HAT-trie counts.

A phrase is a path of word ids (8-byte hashes). Tasks count paths in a HAT-trie:
a shallow trie over the first ids whose leaves are hash containers of the
remaining bytes. A container that grows beyond ``BURST`` paths bursts into a
trie node with a container for each next id. When a trie holds ``LIMIT`` paths,
its largest subtrees leave as sorted runs until half of it is free. Runs are
gathered into blocks of ``OUT`` paths and cut by language, length and first two
ids into ``DEALT`` parts, so that rows grow with the paths and not with the words
that they begin with. Spark deals the parts and merges their counts.

Steps, each of them over all documents
1. Words are counted per language; those found ``LEAST`` times or more go into a
   bitmap of fixed size, since a phrase can't be more frequent than its words.
2. Phrases of two words that the bitmap knows are counted in the same way, and
   those found ``LEAST`` times or more go into a second bitmap.
3. Phrases of three to ``LONGEST`` words whose pairs are all known are counted.
   What a bitmap lets through by mistake is counted and then dropped by its count.
4. Cuts are scored by joins of the frequent paths with themselves, in decimals of
   38 digits. A candidate goes if a longer one by one word holds it as often: a
   still longer one with that property implies such a candidate between them.

Definitions
- A-Z are lower-cased, texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
  those into words ``[^\\x20\\x09]+``. Null and empty texts have no words. A null
  ``lang`` is ``und``, like that value itself. Repeated rows count each time; ids
  and extra columns are ignored. No rows give no rows.
- Words are told apart by 64-bit hashes. Ties of a score go to the smallest cut,
  ties of the ranking to the more frequent and then to the smaller phrase (bytes).
- Texts are never cut: a row is handled as a whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.llm.common import bitmap, in_bitmap, saved, sliced

#: Occurrences that a candidate needs, and its words at most.
LEAST, LONGEST = 100, 5
#: Rows of each language's report.
TOP = 2000
#: Paths of a hash container that bursts, and of a whole trie that spills.
BURST, LIMIT = 8192, 600_000
#: Levels of trie nodes over the containers.
SHALLOW = 2
#: Paths in a batch of runs that leave.
OUT = 100_000
#: Parts that a language's paths are dealt to by their first two ids, and parts of one first word.
DEALT, SPREAD = 512, 64
#: Words whose counts a task gathers before they leave.
GATHER = 1_500_000
ID = 8

_OUTSIDE = np.zeros(256, bool)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_OUTSIDE[[32, 9]] = True
_OUTSIDE |= _BREAK


class HatTrie:
    """Counts of byte paths of whole ids. A node maps an id to a container (dict
    of rest -> count) or to a deeper node (a ``HatTrie``)."""

    def __init__(self, depth: int = 1) -> None:
        self.depth, self.size, self.child = depth, 0, {}

    def add(self, first: bytes, rests: list[bytes], counts: list[int]) -> None:
        """Add ``counts`` to the paths ``first + rest``."""
        below = self.child.get(first)
        if below is None:
            below = self.child[first] = {}
        if isinstance(below, HatTrie):
            before = below.size
            below.add_paths(rests, counts)
            self.size += below.size - before
            return
        before = len(below)
        get = below.get
        for rest, n in zip(rests, counts):
            below[rest] = get(rest, 0) + n
        self.size += len(below) - before
        if len(below) > BURST and self.depth < SHALLOW and len(rests[0]) > ID:  # a rest of one id has no subtree
            node = self.child[first] = HatTrie(self.depth + 1)
            node.add_paths(list(below), list(below.values()))

    def add_paths(self, paths: list[bytes], counts: list[int]) -> None:
        parts: dict[bytes, tuple[list, list]] = {}
        for path, n in zip(paths, counts):
            rests, own = parts.setdefault(path[:ID], ([], []))
            rests.append(path[ID:])
            own.append(n)
        for first, (rests, own) in parts.items():
            self.add(first, rests, own)

    def run(self) -> tuple[list[bytes], list[int]]:
        """All paths in byte order, and their counts."""
        paths, counts = [], []
        for first in sorted(self.child):
            rests, own = _run(self.child[first])
            paths += [first + r for r in rests]
            counts += own
        return paths, counts

    def spill(self, keep: int) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
        """Take the largest subtrees out, each as (first id, sorted rests,
        counts), until no more than ``keep`` paths are left."""
        size = lambda below: below.size if isinstance(below, HatTrie) else len(below)
        for first in sorted(self.child, key=lambda x: -size(self.child[x])):
            if self.size <= keep:
                return
            below = self.child.pop(first)
            self.size -= size(below)
            yield first, *_run(below)


def _run(below: HatTrie | dict[bytes, int]) -> tuple[list[bytes], list[int]]:
    """A subtree as a sorted run."""
    if isinstance(below, HatTrie):
        return below.run()
    rests = sorted(below)
    return rests, [below[r] for r in rests]


class _Blocks:
    """Sorted runs as rows (lang, part, k, paths, counts): the paths of ``k``
    words of one part, end to end."""

    def __init__(self) -> None:
        self.runs, self.size = {}, 0

    def add(self, lang: str, first: bytes, rests: list[bytes], counts: list[int]) -> None:
        for size in {len(r) for r in rests}:
            own = [x for x in zip(rests, counts) if len(x[0]) == size]
            firsts, below, lens, ns = self.runs.setdefault((lang, size // ID), ([], [], [], []))
            firsts.append(first)
            below.append(b"".join([r for r, _ in own]))
            lens.append(len(own))
            ns += [n for _, n in own]
            self.size += len(own)

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size <= least:
            return
        for (lang, more), (firsts, below, lens, ns) in self.runs.items():
            first = np.repeat(np.frombuffer(b"".join(firsts), np.uint64), lens)
            path = np.column_stack([first, np.frombuffer(b"".join(below), np.uint64).reshape(-1, more)])
            # a word's paths go to SPREAD parts at most; sorted, their first ids compress
            part = (textvec.mix(path[:, 0] + path[:, 1] % np.uint64(SPREAD)) % np.uint64(DEALT)).astype(np.int32)
            order = np.lexsort((path[:, 1], path[:, 0], part))
            part, path = part[order], path[order].tobytes()
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            ends, width = np.append(cut, len(part)), (more + 1) * ID
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cut), pa.string()), pa.array(part[cut]), pa.array(np.full(len(cut), more + 1, np.int32)),
                 pa.array([path[i * width:j * width] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.array(ns, np.int64)[order]))],
                ["lang", "part", "k", "paths", "counts"])
        self.runs, self.size = {}, 0


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte, id, joined) of every word; ``joined`` tells
    whether the next word is the next one of its piece."""
    row, a, b, h = textvec.words(column, outside=_OUTSIDE)
    raw, _ = textvec.buffer(column)
    joined = np.zeros(len(h), bool)
    if len(h) > 1:
        breaks = np.append(0, np.cumsum(_BREAK[raw]))
        joined[:-1] = (row[1:] == row[:-1]) & (breaks[a[1:]] == breaks[b[:-1]])
    return row, a, b, h, joined


def _salted(h: np.ndarray, langs: pa.Array, row: np.ndarray) -> np.ndarray:
    """Word ids made different for each language (for the bitmaps)."""
    own = textvec.words(langs, fold=False, outside=np.zeros(256, bool))
    of_lang = np.zeros(len(langs), np.uint64)
    of_lang[own[0]] = own[3]
    return h ^ textvec.mix(of_lang)[row]


def _pair_hash(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textvec.mix(h[:-1] * np.uint64(0x100000001B3) + textvec.mix(h[1:]))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, id, salted, word, n) of the words found ``LEAST`` times or more; the
    others' occurrences are one row without an id for each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return (pa.concat_tables(held).group_by(["lang", "id", "salted"]).aggregate([("word", "min"), ("n", "sum")])
                    .rename_columns(["lang", "id", "salted", "word", "n"]).select(["lang", "id", "salted", "word", "n"]))

        for batch in sliced(batches, "text"):
            row, a, b, h, _ = _words(batch.column("text"))
            if not len(h):
                continue
            s = _salted(h, batch.column("lang"), row)
            u, at, n = np.unique(s, return_index=True, return_counts=True)
            raw, _ = textvec.buffer(batch.column("text"))
            low = raw.copy()
            low[(raw >= 65) & (raw <= 90)] += 32
            low = low.tobytes()
            word = pa.array([low[i:j] for i, j in zip(a[at].tolist(), b[at].tolist())], pa.binary()).cast(pa.string())
            held.append(pa.table([batch.column("lang").take(pa.array(row[at])).cast(pa.string()), pa.array(h[at].view(np.int64)),
                                  pa.array(u.view(np.int64)), word, pa.array(n)], ["lang", "id", "salted", "word", "n"]))
            if sum(t.num_rows for t in held) > GATHER // 4:
                held[:] = [merged()]
                if held[0].num_rows > GATHER // 8:
                    yield from held[0].combine_chunks().to_batches()
                    held.clear()
        if held:
            yield from merged().combine_chunks().to_batches()

    counted = (_with_lang(docs).mapInArrow(run, "lang string, id long, salted long, word string, n long")
               .groupBy("lang", "id", "salted").agg(F.min("word").alias("word"), F.sum("n").alias("n")))
    often = F.col("n") >= LEAST
    return saved(counted.select("lang", *[F.when(often, F.col(c)).alias(c) for c in ("id", "salted", "word")], "n")
                 .groupBy("lang", "id", "salted", "word").agg(F.sum("n").alias("n")))


def _path_counts(docs: DataFrame, words, pairs=None) -> DataFrame:
    """(lang, path, n) of the paths found ``LEAST`` times or more: two words
    that ``words`` knows, or with ``pairs`` three to ``LONGEST`` words whose pairs
    it knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        blocks = _Blocks()
        for batch in sliced(batches, "text"):
            langs = pc.dictionary_encode(batch.column("lang"))
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            row, _, _, h, joined = _words(batch.column("text"))
            if len(h) < 2:
                continue
            s = _salted(h, batch.column("lang"), row)
            known = in_bitmap(words.value, s)
            ok = joined[:-1] & known[:-1] & known[1:]
            if pairs is not None:
                at = np.flatnonzero(ok)
                ok[at] = in_bitmap(pairs.value, _pair_hash(s)[at])
            ids, local = np.unique(h, return_inverse=True)
            ids, width = ids.astype(">u8"), len(ids)
            node = code[row] * width + local  # a path's number; longer ones grow from it word by word
            node = np.unique(node, return_inverse=True)[1]
            for k in range(2, 3 if pairs is None else LONGEST + 1):
                # paths of k words: those of k - 1 and one joined word more
                start = np.flatnonzero(ok) if k == 2 else start[start + k - 2 < len(ok)]
                start = start[ok[start + k - 2]]
                if not len(start):
                    break
                u, first, inv, n = np.unique(node[start] * width + local[start + k - 1], return_index=True, return_inverse=True, return_counts=True)
                grown = np.zeros(len(h), np.int64)
                grown[start] = inv
                node = grown
                if pairs is not None and k == 2:
                    continue
                at = start[first]
                path = ids[local[at[:, None] + np.arange(k)]]
                order = np.lexsort((path[:, 0], code[row[at]]))
                at, path, n = at[order], path[order], n[order]
                lang, head = code[row[at]], path[:, 0]
                cut = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (head[1:] != head[:-1])))
                heads = np.ascontiguousarray(head[cut]).view(f"V{ID}").tolist()
                rests = np.ascontiguousarray(path[:, 1:]).view(f"V{ID * (k - 1)}").ravel().tolist()
                counts = n.tolist()
                for x, (i, j) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(counts)])):
                    name = names[lang[i]]
                    trie = tries.get(name)
                    if trie is None:
                        trie = tries[name] = HatTrie()
                    trie.add(heads[x], rests[i:j], counts[i:j])
            if sum(t.size for t in tries.values()) > LIMIT:
                for name, trie in tries.items():
                    for subtree in trie.spill(trie.size // 2):
                        blocks.add(name, *subtree)
                        yield from blocks.take(OUT)
                tries = {name: trie for name, trie in tries.items() if trie.size}
        for name, trie in tries.items():
            for subtree in trie.spill(0):
                blocks.add(name, *subtree)
                yield from blocks.take(OUT)
        yield from blocks.take()

    runs = _with_lang(docs).mapInArrow(run, "lang string, part int, k int, paths binary, counts array<long>").repartition("lang", "part")
    width = F.col("k") * ID
    entry = F.explode(F.transform("counts", lambda n, i: F.struct(F.substring(F.col("paths"), i * width + 1, width).alias("path"), n.alias("n"))))
    return saved(runs.select("lang", "part", entry.alias("entry")).groupBy("lang", "part", F.col("entry.path").alias("path"))
                 .agg(F.sum("entry.n").alias("n")).where(F.col("n") >= LEAST).select("lang", "path", "n"))


def _id_bytes(c: F.Column) -> F.Column:
    """The 8 bytes of a word id in a path."""
    return F.unhex(F.lpad(F.hex(c), 2 * ID, "0"))


def _part(c: str, first: F.Column, n: F.Column) -> F.Column:
    """``n`` words of a path, from word ``first`` (0: its start) on."""
    return F.substring(F.col(c), first * ID + 1, n * ID)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of ``docs(text, lang)`` by the score of their worst cut."""
    spark = docs.sparkSession
    counted = _word_counts(docs)
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.where("id IS NOT NULL")
    known = spark.sparkContext.broadcast(bitmap(words.select("salted")))
    two = _path_counts(docs, known)
    pair = words.select("lang", _id_bytes(F.col("id")).alias("one"), "salted")
    first, second = pair.toDF("lang", "one", "s1"), pair.toDF("lang", "other", "s2")
    ends = (two.select("lang", _part("path", F.lit(0), F.lit(1)).alias("one"), _part("path", F.lit(1), F.lit(1)).alias("other"))
            .join(first, ["lang", "one"]).join(second, ["lang", "other"]).select("s1", "s2"))
    known_pairs = spark.sparkContext.broadcast(bitmap(_hashed_pairs(ends)))
    more = _path_counts(docs, known, known_pairs)
    found = two.unionByName(more)
    every = saved(found.unionByName(words.select("lang", _id_bytes(F.col("id")).alias("path"), "n")).withColumnRenamed("n", "f"))

    size = (F.length("path") / ID).cast("int")
    candidates = found.withColumnRenamed("n", "a").withColumn("size", size)
    held = (candidates.where("size > 2").select("lang", F.explode(F.array(_part("path", F.lit(0), F.col("size") - 1), _part("path", F.lit(1), F.col("size") - 1))).alias("path"), "a")
            .groupBy("lang", "path").agg(F.max("a").alias("longer")))
    kept = candidates.join(held, ["lang", "path"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = (cuts.withColumn("left", _part("path", F.lit(0), F.col("k"))).withColumn("right", _part("path", F.col("k"), F.col("size") - F.col("k")))
            .join(every.select("lang", F.col("path").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(every.select("lang", F.col("path").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .join(total, "lang")
            .withColumn("score", F.expr("(CAST(1000 * CAST(a AS decimal(17, 0)) AS decimal(20, 0)) * CAST(n AS decimal(17, 0))) div (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0)))")))
    worst = saved(cuts.groupBy("lang", "path", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
                  .select("lang", "path", "size", "a", "n", "cut.score", "cut.l", "cut.r"))

    said = (worst.select("lang", "path", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: _part("path", i, F.lit(1)))).alias("place", "one"))
            .join(words.select("lang", _id_bytes(F.col("id")).alias("one"), "word"), ["lang", "one"])
            .groupBy("lang", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (worst.join(said, ["lang", "path"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _hashed_pairs(ends: DataFrame) -> DataFrame:
    """The bitmap's hash of each pair of salted ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            h = _pair_hash(np.column_stack([s1, s2]).ravel())[::2] if len(s1) else s1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return ends.mapInArrow(run, "h long")
