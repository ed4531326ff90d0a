"""N-gram Jaccard join by vertical partitioning.

Documents are sets of five-word shingles under one global order. The order is
cut into fragments; a pair's overlap is counted in each fragment on its own
and the partial counts are summed per pair, so no row ever holds more than a
fragment of a set, and all fragments of a pair can be counted in parallel.

Steps
1. One scan hashes every text into its set: size, a 64-bit class id (equal for
   equal sets), a sketch, and shingles seen in several documents at a time.
   Documents of equal sets are one class; only classes are joined.
2. Global order: shingles known to be frequent (at most ``HOT`` of them, which
   bounds the broadcast) come last, the others are ordered by hash. Which ones
   are known changes the work, never the result.
3. Two sets that link share a shingle among the first
   ``size - ceil(0.75 * size) + 1`` of either. Those prefixes are the postings,
   dealt once by key; keys that only one class has are dropped there. The rows
   of frequent keys are salted.
4. Each class is compared with its keys' pivot (the key's first class), which
   is linear in the postings and joins groups of near copies at once. Then
   keys whose classes are all in one component are done. While the others have
   many pairs for their rows, and far fewer than a pivot before, they get further
   pivots, one and then more, drawn for each key by itself, so that a class which
   links with few of its group still meets one of them; at last every untested
   pair of classes that share a key and a size band and are in different
   components is compared. A pair leaves a join only if what follows the key in
   both sets can make it a link, which holds for the first key that a link
   shares. Links inside a component can't change it, so none that matters is lost.
5. A set's sketch holds the parity of its shingles in each of some bits. Bits
   in which two sketches differ are no more than the shingles that one set alone
   has, so pairs with too many of them are no links, and their sets aren't made.
   The others' partial overlaps come from the fragments of both sets; the sums
   are tested exactly (100 * intersection >= 75 * union).

Definitions
- Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of one to
  four words is one shingle; a null or empty text is an empty set, linked with
  nothing; its component_id is its own doc_id.
- Repeated rows are documents of their own with equal sets. Rows may share a
  doc_id; a null doc_id is linked like others but is never a component_id
  unless its component has no other. Extra columns are ignored.
- Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.llm.common import components, forget, saved, sliced

WIDTH, NUM, DEN = 5, 75, 100
#: Known frequent shingles: at most so many (8 bytes each) are broadcast.
HOT = 1 << 19
#: Documents that a shingle must have been seen in together to count as hot.
HOT_DOCS = 16
#: Shingles a task gathers before it looks for repeated ones.
WINDOW = 1_500_000
#: Fragments of the global order: so many ranges of the hash, and the hot rest.
FRAGMENTS = 16
#: Bits of a sketch: at least twice the set's size, and no more than the second.
#: Larger sets' sketches rule out less, which costs work only.
SKETCH_BITS = 64, 1 << 17
#: Parts that the rows of a frequent key are dealt to.
SALTS = 64
#: Pivot rounds go on while all pairs would be so many times the rows and no more
#: than this part of those before the last pivot; they end after the last round in any case.
WORTH, LEFT, PIVOT_ROUNDS = 10, 0.9, 6
#: Pivots of a key in the first further round are one, in the n-th this to the n-th power.
MORE = 4
#: Size of the bitmap that tells tasks which documents to make sets of again.
BITS = 1 << 24


def _sketches(r: np.ndarray, s: np.ndarray, first: np.ndarray) -> pa.Array:
    """The parities of each row's shingles by their low bits, as binaries whose
    sizes are powers of two."""
    n = np.diff(first)
    least, most = SKETCH_BITS
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), least, most)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits)])
    at = ends[r] + (s & (bits[r] - 1).view(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends // 8), pa.py_buffer(np.packbits(parity, bitorder="little"))])


def _differences(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the larger one folded to the other's
    size; the shingles that only one of the sets has are no fewer."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: one for each document (doc_id, n, cid, sketch), and
    (shingle, n) for shingles that several documents of a window have."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[np.ndarray] = []

        def often() -> Iterator[pa.RecordBatch]:
            if window:
                s, n = np.unique(np.concatenate(window), return_counts=True)
                s, n = s[n > 1], n[n > 1]
                window.clear()
                none = pa.nulls(len(s))
                yield _batch([none.cast(id_type), n, none.cast(pa.int64()), none.cast(pa.large_binary()), s.view(np.int64)])

        id_type = None
        for batch in sliced(batches, "text"):
            id_type = batch.column("doc_id").type
            r, s, first = textvec.shingle_sets(batch.column("text"), WIDTH)
            n = np.diff(first)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
            cid = textvec.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64)
            yield _batch([batch.column("doc_id"), n, cid, _sketches(r, s, first), pa.nulls(len(n), pa.int64())])
            distinct = np.unique(cid, return_index=True)[1]  # copies of one set count once
            own = np.zeros(len(n), bool)
            own[distinct] = True
            window.append(s[own[r]])
            if sum(map(len, window)) > WINDOW:
                yield from often()
        yield from often()

    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "n", "cid", "sketch", "shingle"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cid long, sketch binary, shingle long")


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each id in a bitmap of ``BITS`` bits."""
    h = textvec.mix(ids.astype(np.int64).view(np.uint64))
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) % BITS


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap that holds every id of ``ids`` (id); ``BITS / 64`` words of it
    come to the driver at most, however many ids there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITS, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
                own[at] = True
        words = np.packbits(own, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "bits"])

    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(BITS // 64, np.int64)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return words


def _ordered(docs: DataFrame, hot, wanted=None) -> DataFrame:
    """With ``wanted`` (a bitmap of doc_id hashes), for the documents in it: (cid,
    frag, part) with the shingles of each fragment; without, (key, cid, rest), the
    prefix of each set. ``rest`` packs a salt (frequent keys' rows are salted by
    class, the others have salt 0), the set's size and the key's place into one
    number. Sets that one task meets again are left out."""
    whole = wanted is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        bits = np.unpackbits(wanted.value.view(np.uint8), bitorder="little").view(bool) if whole else None
        seen: set[int] = set()
        if whole:
            batches = (b.filter(pa.array(np.logical_and(*[bits[at] for at in _bits(b.column("id").to_numpy(zero_copy_only=False))]))) for b in batches)
        for batch in sliced(batches, "text"):
            r, s, first = textvec.shingle_sets(batch.column("text"), WIDTH, known)
            n = np.diff(first)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
            cid = textvec.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64)
            if len(seen) > 200_000:
                seen.clear()
            own = np.zeros(len(n), bool)
            for i, c in enumerate(cid.tolist()):
                if c not in seen and n[i]:
                    seen.add(c)
                    own[i] = True
            place = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
            is_hot = known[place] == s if len(known) else np.zeros(len(s), bool)
            if whole:
                frag = np.where(is_hot, FRAGMENTS, (s >> np.uint64(32)).astype(np.int64) * FRAGMENTS >> 32)
                take, rows = own[r], np.flatnonzero(own)
                code, part = (r * (FRAGMENTS + 1) + frag)[take], s[take].view(np.int64)
                every = (rows[:, None] * (FRAGMENTS + 1) + np.arange(FRAGMENTS + 1)).ravel()  # empty fragments too
                cut = np.append(np.searchsorted(code, every), len(part)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cid[every // (FRAGMENTS + 1)]), pa.array((every % (FRAGMENTS + 1)).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(part))], ["cid", "frag", "part"])
            else:
                head = n - (n * NUM + DEN - 1) // DEN + 1
                take = own[r] & (np.arange(len(s)) - first[r] < head[r])
                c = cid[r[take]]
                salt = np.where(is_hot[take], 1 + c % SALTS, 0)
                rest = ((salt << 28) + n[r[take]] << 28) + (np.arange(len(s)) - first[r])[take]
                yield pa.RecordBatch.from_arrays([pa.array(s[take].view(np.int64)), pa.array(c), pa.array(rest)], ["key", "cid", "rest"])

    return docs.select("text", *[_id().alias("id")] * whole).mapInArrow(
        run, "cid long, frag int, part array<long>" if whole else "key long, cid long, rest long")


def _id():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _may_link(a: str, b: str):
    """Whether two sets (structs ``cid, n, at``) whose first shared key is this
    one can be a link: before it they share nothing, and from it on no more than
    the smaller remainder. A link has such a first key, so none is lost."""
    a, b = F.col(a), F.col(b)
    return F.least(a["n"] - a["at"], b["n"] - b["at"]) * (NUM + DEN) >= NUM * (a["n"] + b["n"])


def link_classes(docs: DataFrame, first: DataFrame, hot) -> DataFrame | None:
    """(node, root) of the classes that have links. ``first``: (cid, doc_id, n,
    sketch), one document of each class."""
    group = Window.partitionBy("key", "salt")
    field = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit((1 << 28) - 1))
    unpacked = lambda cid, rest: F.struct(cid.alias("cid"), field(rest, 28).alias("n"), field(rest, 0).alias("at"))
    shared = saved(_ordered(docs, hot).withColumn("salt", F.shiftright("rest", 56).cast("int"))
                   .withColumns({"low": F.min("cid").over(group), "high": F.max("cid").over(group), "low_rest": F.min_by("rest", "cid").over(group)})
                   .where("salt > 0 OR low != high")
                   .select("key", "salt", unpacked(F.col("cid"), F.col("rest")).alias("x"), unpacked(F.col("low"), F.col("low_rest")).alias("low")))
    forget(shared, keep=True)
    tested = roots = None
    rows, round_, before, now = shared, 0, math.inf, 0.0
    while True:
        if round_ and round_ <= PIVOT_ROUNDS:
            before, now = now if round_ > 1 else math.inf, _all_pairs(rows)
        if round_ == 0:
            heads = rows.where("salt > 0").select("key", "low").distinct()  # a frequent key's pivots meet each other
            top = heads.groupBy("key").agg(F.min("low").alias("y"))
            pairs = (rows.where("x.cid != low.cid").selectExpr("x", "low AS y")
                     .unionByName(heads.join(top, "key").where("low.cid != y.cid").selectExpr("low AS x", "y"))).where(_may_link("x", "y"))
        elif round_ <= PIVOT_ROUNDS and WORTH * rows.count() < now <= LEFT * before:
            # each key draws its own, so that a class meets many of its group, not one by all of their keys
            drawn = Window.partitionBy("key").orderBy(F.xxhash64("x.cid", "key", F.lit(round_)), "x.cid")
            pivot = (rows.select("key", F.struct("x", "root").alias("p"), F.row_number().over(drawn).alias("_rank"))
                     .where(F.col("_rank") <= (1 if round_ == 1 else MORE ** round_)).drop("_rank"))
            pairs = rows.join(pivot, "key").where("root != p.root").select("x", F.col("p.x").alias("y")).where(_may_link("x", "y"))
        else:
            # sizes of a link differ by one band at most, so a band meets itself and the one below it
            band = lambda c: F.floor(F.log(F.col(c).cast("double")) / math.log(DEN / NUM)).cast("int")
            left = rows.withColumn("band", F.explode(F.array(band("x.n"), band("x.n") + 1)))
            right = rows.select("key", F.col("x").alias("y"), F.col("root").alias("root2"), band("x.n").alias("band"))
            meets = ((band("x.n") < F.col("band")) | (F.col("x.cid") < F.col("y.cid"))) & (F.col("root") != F.col("root2")) & _may_link("x", "y")
            pairs = left.join(right, ["key", "band"]).where(meets).select("x", "y")
            round_ = None
        small, large = F.least("x", "y"), F.greatest("x", "y")
        pairs = pairs.select(small["cid"].alias("a"), large["cid"].alias("b"), small["n"].alias("na"), large["n"].alias("nb")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        if pairs.limit(1).count():
            new = _verified(docs, first, hot, pairs)
            roots = components(new) if roots is None else _joined(roots, new)
        if round_ is None:
            return roots
        rows = shared.select("key", "x")
        if roots is not None:
            rows = rows.join(roots, F.col("x.cid") == F.col("node"), "left").drop("node")
        rows = rows.withColumn("root", F.coalesce("root", "x.cid") if roots is not None else F.col("x.cid"))
        key = Window.partitionBy("key")
        rows = saved(rows.withColumns({"r0": F.min("root").over(key), "r1": F.max("root").over(key)}).where("r0 != r1").drop("r0", "r1"))
        if not rows.limit(1).count():
            return roots
        round_ += 1


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): those between
    components are followed over the components, not over all nodes again."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    every = saved(roots.unionByName(ends.join(roots, "node", "left_anti").withColumn("root", F.col("node"))))
    over = links.join(every.toDF("a", "x"), "a").join(every.toDF("b", "y"), "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    moved = components(over).toDF("root", "least")
    return saved(every.join(moved, "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def _all_pairs(rows: DataFrame) -> float:
    """Pairs of rows that share a key and differ in their root."""
    each = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("key").agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q"))
    return per.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0.0


def _likely(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that may be links by their sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            # o shared shingles with o * DEN >= (na + nb - o) * NUM leave na + nb - 2 * o for one set alone
            spare = na + nb - 2 * -(-(na + nb) * NUM // (NUM + DEN))
            sides = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("sa", "sb"))
            differ = np.array([_differences(x, y) for x, y in zip(*sides)], np.int64)
            yield batch.filter(pa.array(differ <= spare)).select(["a", "b", "na", "nb"])

    sketch = first.select("cid", "sketch")
    return (pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(run, "a long, b long, na long, nb long"))


def _verified(docs: DataFrame, first: DataFrame, hot, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose partial overlaps sum to a link. The sets of
    the classes that may be links by their sketches are made once more from
    their texts."""
    some = saved(_likely(pairs, first))
    wanted = some.select(F.col("a").alias("cid")).union(some.select("b")).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(first.join(wanted, "cid").select(_id().alias("id"))))
    whole = saved(_ordered(docs, hot, bitmap))
    x = whole.select(F.col("cid").alias("a"), "frag", F.col("part").alias("pa"))
    y = whole.select(F.col("cid").alias("b"), "frag", F.col("part").alias("pb"))
    each = some.join(x, "a").join(y, ["b", "frag"]).select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("pa", "pb")).alias("o"))
    each = each.groupBy("a", "b", "na", "nb", "frag").agg(F.max("o").cast("long").alias("o"))  # a set may be there twice
    sums = each.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    links = saved(sums.where(F.col("o") * DEN >= (F.col("na") + F.col("nb") - F.col("o")) * NUM).select("a", "b"))
    forget(whole, some)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    scanned = saved(_sets(docs))
    often = (scanned.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "shingle").limit(HOT))
    hot = spark.sparkContext.broadcast(np.sort(often.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)))
    rows = scanned.where("shingle IS NULL").select("doc_id", "n", "cid", "sketch")
    first = saved(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    roots = link_classes(docs, first, hot)
    if roots is None:
        named = first.select("cid", F.col("doc_id").alias("component_id"))
    else:
        own = first.select("cid", "doc_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("cid", "component_id")
    found = rows.where("n > 0").join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
