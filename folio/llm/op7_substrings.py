"""Substring dedup by compact windows.

A compact window is a node of the Cartesian tree over a text's hashes: all
passages inside its range that hold its minimum share that minimum. Passages of
``WORDS`` words are looked at: those that start in [l, r] have one signature.
Repeats of more words hold such passages, so longer ones aren't needed.

Steps
1. Equal texts are one text (xxhash64 of the text); its further copies are
   repeats as a whole. Positions are shingles of five words.
2. Each of ``BANDS`` signatures is an interval join of the windows of two hash
   functions: where their ranges of starts overlap, both minima must agree, so
   that one common phrase is no signature. Passages of a similarity of 0.75 share
   one with a probability of 1 - (1 - 0.75^2)^5 = 98.4 %, equal ones share all.
   Signatures are counted first; those that one text alone has are dropped before
   their windows are written. The others are joined with the signature's first
   text (its pivot), which is linear in the windows.
3. A text and a pivot's text are verified on word shingles: a passage of
   ``WORDS`` words or more whose shingle sets have a Jaccard similarity of 0.75
   or more is a repeat.
4. Passages that no verified one holds may be near copies of another text than
   the pivot. Two passages of ``RUN`` shingles that have ``HITS`` in common share
   one of the ``PREFIX`` first shingles of either, in any order that all texts
   have in common; rare shingles come first, so that a frequent phrase is no key.
   Texts that share such a key are verified: while all pairs would be many for the
   rows, with the key's first open text (which then is done), at last in pairs,
   keys salted. Only pairs without an open passage are left out. The step loses
   none of those passages; near copies with three to six words put in at one
   place may share such a key or not. Of passages of n < ``RUN`` distinct shingles
   at most n / 4 aren't in a similar one, so that n / 4 + 1 are enough there.

Definitions
- Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; spans count words from 0,
  ends excluded. "First" is the smaller text hash, so which of the texts keeps
  a shared passage is fixed but not by doc_id; of equal texts it is the
  smallest doc_id. Repeats inside one text are left alone.
- Null texts and texts of fewer than ``WORDS`` words have no repeats. Rows that
  repeat a doc_id with the same text count once. Extra columns pass through
  ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.llm.common import bitmap, forget, in_bitmap, saved, sliced

#: Two hash functions for each of ``BANDS`` signatures.
WORDS, SHINGLE, BANDS = 50, 5, 5
#: Positions that a passage of ``WORDS`` words has.
RUN = WORDS - SHINGLE + 1
NUM, DEN = 75, 100
#: Of ``RUN`` positions, the hits that a similarity of 0.75 takes.
HITS = -(-2 * RUN * NUM // (NUM + DEN))
#: A passage that reaches no further out of a verified one has its source: what
#: is left of it when that one is cut is no passage.
EDGE = RUN - HITS
#: Of two passages of ``RUN`` shingles that have ``HITS`` in common, each has one
#: of those among its first so many.
PREFIX = RUN - HITS + 1
#: Numbers of texts that make a shingle rank behind those of fewer texts.
OFTEN = (2, 16, 256)
#: Pivot rounds go on while all pairs would be so many times the rows, and end
#: after the last one in any case; parts that the rows of a key are dealt to.
WORTH, ROUNDS, SALTS = 1, 6, 8
_SPAN = "tid long, start int, end int, ptid long, pstart int, pend int"


def text_id(text: str = "text"):
    return F.xxhash64(text)


def compact_windows(v: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least ``width`` positions: the
    nodes of the Cartesian trees over the texts' hashes ``v`` whose range is that
    wide, in order of ``c``. Every passage inside [l, r] that holds ``c`` has its
    minimum there; of equal minima the first one is the parent. ``first`` and
    ``last`` are the ends of each position's text. ``l`` and ``r`` stop at
    ``width`` - 1 positions from ``c``: no passage of that width reaches further.

    A node's range ends before the nearest smaller hash on either side. Minima
    of 1, 2, 4, ... positions find it for all nodes at a time, in as many steps
    as ``width`` has bits."""
    n, least, span = len(v), [v], 1
    while 2 * span < 2 * width:
        below = least[-1]
        least.append(np.minimum(below[:-span], below[span:]) if len(below) > span else below[:0])
        span *= 2
    # only a position that is the minimum of some passage is a node this wide
    top = max(k for k in range(len(least)) if 1 << k <= width)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    low = np.minimum(least[top][:n - width + 1], least[top][width - (1 << top):n - (1 << top) + 1])
    inside = last[:n - width + 1] >= np.arange(n - width + 1) + width - 1
    reach = np.zeros(n + width - 1, np.uint64)
    reach[width - 1:n] = np.where(inside, low, 0)  # passages by start, shifted so that c's are reach[c:c + width]
    span = 1
    while 2 * span <= width:
        reach, span = np.maximum(reach[:-span], reach[span:]), 2 * span
    reach = np.maximum(reach[:n], reach[width - span:width - span + n])
    c = np.flatnonzero(reach == v)
    own, left, right = v[c], c.copy(), c + 1
    for k in range(len(least) - 1, -1, -1):
        step, mins = 1 << k, least[k]
        if not len(mins):
            continue
        at = left - step
        ok = (at >= first[c]) & (c - at < width) & (mins[np.clip(at, 0, len(mins) - 1)] > own)
        left = np.where(ok, at, left)
        ok = (right + step - 1 <= last[c]) & (right + step - 1 - c < width) & (mins[np.clip(right, 0, len(mins) - 1)] >= own)
        right = np.where(ok, right + step, right)
    wide = right - left >= width
    return left[wide], c[wide], right[wide] - 1


def _passages(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, minimum): passages of ``RUN`` positions that start in
    [start, end] belong to one compact window. The ranges don't overlap."""
    l, c, r = compact_windows(v, first, last, RUN)
    return np.maximum(l, c - RUN + 1), np.minimum(c, r - RUN + 1), v[c]


def _hashes(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each shingle."""
    return textvec.mix(s ^ textvec.mix(np.array([k + 1], np.uint64)))


def windows(texts: DataFrame, known=None) -> DataFrame:
    """``texts`` (tid, text) to (key, tid, l, r): the passages of ``WORDS`` words
    that start in [l, r] have one signature. A signature is an interval join of
    the compact windows of two hash functions: where they overlap, both minima
    hold. With ``known`` (a bitmap) only signatures that it knows; without, only
    (key, t), ``t`` being 32 bits of the text's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, "text"):
            if len(seen) > 200_000:
                seen.clear()
            tids = batch.column("tid").to_pylist()
            new = [i for i, t in enumerate(tids) if t not in seen and not seen.add(t)]  # not a copy that this task has met
            row, _, _, h = textvec.words(batch.column("text"))
            at, s = textvec.shingles(row, h, SHINGLE)
            if len(s) < RUN:
                continue
            mine = np.isin(row[at], new)
            r, s = row[at][mine], s[mine]
            bounds = np.searchsorted(r, np.arange(batch.num_rows + 1))
            first, last = bounds[r], bounds[r + 1] - 1
            owner = np.array(tids, np.int64)
            for band in range(BANDS):
                (a, ae, x), (b, be, y) = (_passages(_hashes(s, k), first, last) for k in (2 * band, 2 * band + 1))
                if not len(a):
                    continue
                # both lists of ranges cover the same starts without a gap inside a text
                l = np.union1d(a, b)
                i, j = np.searchsorted(a, l, side="right") - 1, np.searchsorted(b, l, side="right") - 1
                end = np.minimum(ae[i], be[j])
                key = textvec.mix(x[i] + textvec.mix(y[j] + np.uint64(band)))
                if known is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner[r[l]].astype(np.int32))], ["key", "t"])
                    continue
                some = in_bitmap(known.value, key)
                l, end, key = l[some], end[some], key[some]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner[r[l]]), pa.array((l - first[l]).astype(np.int32)),
                                                  pa.array((end - first[l]).astype(np.int32))], ["key", "tid", "l", "r"])

    return texts.select("tid", "text").mapInArrow(run, "key long, t int" if known is None else "key long, tid long, l int, r int")


def shared_windows(texts: DataFrame) -> DataFrame:
    """Windows whose signature several texts may have. Signatures are counted
    first (8 bytes and 32 bits of a text each); those of one text alone are never
    written with their windows, but for the few that the bitmap of the others
    lets through. A larger corpus lets more through: that costs work only."""
    def often() -> np.ndarray:
        return bitmap(windows(texts).groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low != high").select("key"))

    known = texts.sparkSession.sparkContext.broadcast(often())
    forget(texts, keep=True, settle=True)  # the counts' shuffle goes before the windows are written
    return saved(windows(texts, known))


def _segments(hit: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in which every ``RUN`` positions, hits or not, hold ``HITS`` hits."""
    if len(hit) < RUN:
        return []
    sums = np.concatenate([[0], np.cumsum(hit)])
    good = sums[RUN:] - sums[:-RUN] >= HITS
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for x, y in zip(edge[::2].tolist(), (edge[1::2] - 1 + RUN).tolist()):
        if out and x < out[-1][1]:
            x = out.pop()[0]
        out.append((x, y))
    return out


def _by_run(b: np.ndarray) -> np.ndarray:
    """Places of the shingles ``b`` in order of their hashes; of equal ones the
    place that begins the longest row of them comes first, then the first one."""
    order = np.argsort(b, kind="stable")
    same = b[1:] == b[:-1]
    if not same.any():
        return order
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.ones(len(b), np.int64)
    size[head] = np.diff(np.append(head, len(b)))
    return np.lexsort((-size, b))


def _near(a: np.ndarray, b: np.ndarray, hit: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Near copies (x, y, p, q) among the shingles ``a`` and ``b``; a range that
    isn't one as a whole is cut where the places jump, or else into halves."""
    out, todo = [], _segments(hit)[::-1]
    while todo:
        x, y = todo.pop()
        near = x + np.flatnonzero(hit[x:y])
        if len(near) < HITS:
            continue
        # edges that aren't hits go, as long as RUN positions are left
        lead, tail = int(near[0]) - x, y - 1 - int(near[-1])
        spare = y - x - RUN
        if lead + tail <= spare:
            u, v = x + lead, y - tail
        else:
            cut = min(lead, (spare + 1) // 2 if tail >= spare // 2 else spare - tail)
            u, v = x + cut, y - (spare - cut)
        shift = place[near] - near
        least = int(np.median(shift))
        one = np.unique(a[u:v])
        held = place[near]
        low = int(held.min())
        # (the last one is for passages that say the same again and again: their places stand still)
        for p, q in ((u + least, v + least), (u + int(shift[0]), v + int(shift[-1])), (low, max(int(held.max()) + 1, low + RUN))):
            p, q = max(0, min(p, len(b) - RUN)), min(len(b), max(q, RUN))
            if q - p < RUN:
                continue
            two = np.unique(b[p:q])
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both * DEN >= (len(one) + len(two) - both) * NUM:
                out.append((u, v, p, q))
                break
        else:
            jumps = np.flatnonzero(np.abs(np.diff(shift)) > RUN - HITS)
            if len(jumps):
                ends = [x, *((near[jumps] + near[jumps + 1] + 1) // 2).tolist(), y]
                parts = [(int(c), int(d)) for c, d in zip(ends, ends[1:])]
            else:
                m = (x + y) // 2
                parts = [(x, m), (m, y)] if y - x >= 2 * RUN else [(x, x + RUN), (y - RUN, y)] if y - x > RUN else []
            for c, d in parts[::-1]:
                if d - c < RUN:  # take in what is around, which need not be hits
                    c = max(x, min(c - (RUN - d + c) // 2, y - RUN))
                    d = c + RUN
                if (c, d) != (x, y):
                    todo.append((c, d))
    return out


def _verify(pairs: DataFrame) -> DataFrame:
    """``pairs`` (tid, text, ptid, ptext) to the spans of both texts that are
    near copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in sliced(batches, "ptext"):
            for batch in sliced(iter([big]), "text"):
                side = []
                for name in ("text", "ptext"):
                    row, _, _, h = textvec.words(batch.column(name))
                    at, s = textvec.shingles(row, h, SHINGLE)
                    side.append((s, np.searchsorted(row[at], np.arange(batch.num_rows + 1))))
                (sa, fa), (sb, fb) = side
                out = []
                for i, (tid, ptid) in enumerate(zip(batch.column("tid").to_pylist(), batch.column("ptid").to_pylist())):
                    a, b = sa[fa[i]:fa[i + 1]], sb[fb[i]:fb[i + 1]]
                    order = _by_run(b)
                    place = np.minimum(np.searchsorted(b[order], a), max(len(b) - 1, 0))
                    hit = b[order][place] == a if len(b) else np.zeros(len(a), bool)
                    for x, y, p, q in _near(a, b, hit, order[place] if len(b) else place):
                        out.append((tid, x, y + SHINGLE - 1, ptid, p, q + SHINGLE - 1))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(("tid", "start", "end", "ptid", "pstart", "pend"), x)) for x in out],
                                                     pa.schema([(n, pa.int64() if n.endswith("tid") else pa.int32())
                                                                for n in ("tid", "start", "end", "ptid", "pstart", "pend")]))

    return pairs.select("tid", "text", "ptid", "ptext").mapInArrow(run, _SPAN)


def _starts(batch: pa.RecordBatch, first: np.ndarray, column: str, l: str, r: str, less: int = 0, edge: int = 0) -> np.ndarray:
    """Which positions lie in [l - edge, r - less + edge] of one of their text's ranges."""
    lists = batch.column(column)
    flat, n = lists.flatten(), int(first[-1])
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), sizes)
    a, b = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) + first[of] for x in (l, r))
    a, b = np.maximum(a - edge, first[of]), np.minimum(b - less + edge + 1, first[of + 1])
    edges = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _heads(order: np.ndarray, x: np.ndarray, similar: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(start, position) of the ``PREFIX`` first distinct hashes, by ``order``,
    of the ``RUN`` positions from each start in ``x`` on. With ``similar`` fewer
    where few are distinct: of n, those that a similarity of ``NUM`` / ``DEN``
    lets go and one more."""
    v = order[x[:, None] + np.arange(RUN)]
    low = np.sort(v, axis=1)
    rank = np.ones(low.shape, np.int64)
    rank[:, 1:] = low[:, 1:] != low[:, :-1]
    rank = np.cumsum(rank, axis=1)
    most = np.minimum(PREFIX, rank[:, -1] * (DEN - NUM) // DEN + 1 if similar else rank[:, -1])  # of fewer distinct ones all
    last = low[np.arange(len(x)), np.argmax(rank >= most[:, None], axis=1)]
    i, j = np.nonzero(v <= last[:, None])
    return x[i], x[i] + j


def _prefixes(texts: DataFrame, classes=None, known=None, similar: bool = False) -> DataFrame:
    """``texts`` (tid, text, ws, open, cut): ``ws`` are ranges of starts of
    passages, ``open`` those that need a source, ``cut`` the verified spans.

    Without ``classes`` (key, tid), the distinct shingles of the passages; with
    ``classes`` (bitmaps of ever more frequent shingles) (key, tid, l, r), the
    shingles among the ``PREFIX`` first of passages that start in [l, r]: of open
    ones, or with ``known`` (a bitmap) those of the others that it knows. A shingle
    that one text alone has is no key. With ``similar`` passages of few distinct
    shingles (one word again and again) have fewer keys, as in ``_heads``: their
    most frequent shingle is the last of them, not one that all of them share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, _, _, h = textvec.words(batch.column("text"))
            at, s = textvec.shingles(row, h, SHINGLE)
            first = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
            owner, tid = row[at], np.array(batch.column("tid").to_pylist(), np.int64)
            every = _starts(batch, first, "ws", "l", "r")
            if classes is None:
                mine = np.flatnonzero(np.convolve(every, np.ones(RUN, np.int64))[:len(s)] > 0) if every.any() else np.zeros(0, np.int64)
                mine = mine[np.lexsort((s[mine], owner[mine]))]
                new = np.ones(len(mine), bool)
                new[1:] = (s[mine][1:] != s[mine][:-1]) | (owner[mine][1:] != owner[mine][:-1])
                mine = mine[new]
                yield pa.RecordBatch.from_arrays([pa.array(s[mine].view(np.int64)), pa.array(tid[owner[mine]])], ["key", "tid"])
                continue
            need = _starts(batch, first, "open", "l", "r") & ~_starts(batch, first, "cut", "start", "end", WORDS, EDGE)
            level = np.sum([in_bitmap(words, s) for words in classes.value], axis=0, dtype=np.uint64) if len(s) else s
            order = (s >> np.uint64(2)) | (level << np.uint64(62))
            # a passage whose own shingles fill its prefix has no key
            by = np.lexsort((np.arange(len(s)), s, owner))
            twin = np.zeros(len(s), bool)
            twin[by[1:]] = (s[by[1:]] == s[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]])
            own = np.concatenate([[0], np.cumsum((level == 0) & ~twin)])
            x = np.flatnonzero(need if known is None else every & ~need)
            x = x[own[x + RUN] - own[x] < PREFIX]
            parts = [_heads(order, part, similar) for part in np.array_split(x, 1 + len(x) // 50_000)] if len(x) else []
            start, place = (np.concatenate(c) for c in zip(*parts)) if parts else (x, x)
            key = level[place] > 0
            if known is not None:
                key &= in_bitmap(known.value, s[place])
            start, place = start[key], place[key]
            by = np.lexsort((start, place))
            start, place = start[by], place[by]
            head = np.flatnonzero(np.diff(place, prepend=-1))
            tail = np.append(head[1:], len(place)) - 1
            at, low = place[head], first[owner[place[head]]]
            yield pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), pa.array(tid[owner[at]]), pa.array((start[head] - low).astype(np.int32)),
                                              pa.array((start[tail] - low).astype(np.int32) if len(head) else np.zeros(0, np.int32))], ["key", "tid", "l", "r"])

    return texts.select("tid", "text", "ws", "open", "cut").mapInArrow(run, "key long, tid long" if classes is None else "key long, tid long, l int, r int")


def _among_rest(shared: DataFrame, spans: DataFrame, kept: DataFrame, tested: DataFrame, verify) -> DataFrame:
    """``spans`` and those of passages that aren't near their pivots. ``shared``
    (key, tid, l, r, ptid) are the windows, ``kept`` their texts, ``tested`` the
    pairs so far; ``verify`` makes spans of pairs."""
    spark = shared.sparkSession
    place = F.struct("l", "r")
    own = shared.groupBy("tid").agg(F.collect_set(place).alias("ws"), F.collect_set(F.when(F.col("tid") != F.col("ptid"), place)).alias("open"))  # of one text
    cut = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    forget(spans, keep=True, settle=True)
    texts = saved(own.join(cut, "tid", "left").join(kept, "tid"))
    counts = saved(_prefixes(texts).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN[0]))
    classes = spark.sparkContext.broadcast([bitmap(counts.where(F.col("n") >= n).select("key")) for n in OFTEN])
    need = saved(_prefixes(texts, classes, similar=True))
    known = spark.sparkContext.broadcast(bitmap(need.select("key")))
    source = rows = saved(need.withColumn("open", F.lit(True)).unionByName(_prefixes(texts, classes, known, True).withColumn("open", F.lit(False))))
    forget(counts, need, texts, settle=True)
    for level in range(ROUNDS + 1):
        if level:  # what a verified span holds has its source
            c = spans.select(F.col("tid").alias("ctid"), "start", "end")
            held = F.col("open") & (F.col("tid") == F.col("ctid")) & (F.col("l") >= F.col("start") - EDGE) & (F.col("r") + WORDS - EDGE <= F.col("end"))
            rows = rows.join(c, held, "left_anti").unionByName(rows.join(c, held, "left_semi").withColumn("open", F.lit(False)))
        by_text = saved(rows.groupBy("key", "tid").agg(F.max("open").alias("open")))
        keys = saved(by_text.groupBy("key").agg(F.min(F.when(F.col("open"), F.col("tid"))).alias("pivot"), F.count(F.lit(1)).alias("n"),
                                                F.sum(F.col("open").cast("long")).alias("m")).where("m > 0 AND n > 1"))
        size = keys.agg(F.sum("n"), F.sum(F.expr("m * (n - (m + 1.0) / 2)"))).first()
        if not size[0]:
            break
        last = level == ROUNDS or size[1] <= WORTH * size[0]
        if last:
            live = by_text.join(keys.select("key"), "key", "left_semi")
            dealt = live.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int"))
            spread = live.where("open").select("key", F.col("tid").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            met = dealt.join(spread, ["key", "salt"]).where("tid != other AND (NOT open OR tid > other)")
        else:
            met = by_text.join(keys.select("key", F.col("pivot").alias("other")), "key").where("tid != other")
        pairs = met.select(F.greatest("tid", "other").alias("tid"), F.least("tid", "other").alias("ptid")).distinct()
        pairs = saved(pairs.join(tested, ["tid", "ptid"], "left_anti"))
        spans = spans.unionByName(saved(verify(pairs)))
        if last:
            break
        tested = tested.unionByName(pairs)
        before, rows = source, saved(rows.join(keys.select("key", "pivot"), "key")
                                     .withColumn("open", F.col("open") & (F.col("tid") != F.col("pivot"))).drop("pivot"))
        source = rows
        forget(before, by_text, keys)
    forget(source, by_text, keys)
    return spans


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(tid, start, end, ptid, pstart, pend): passages of a text that repeat
    one of a text before it; ``tid`` is the hash of the text."""
    texts = docs.where("text IS NOT NULL").select(text_id().alias("tid"), "text")
    rows = shared_windows(texts)  # read by the aggregate and by the join

    def with_pivots() -> DataFrame:
        pivots = rows.groupBy("key").agg(F.min("tid").alias("ptid"), F.max("tid").alias("high")).where("ptid != high").select("key", "ptid")
        return saved(rows.join(pivots, "key").select("tid", "l", "r", "ptid").distinct())

    shared = with_pivots()
    forget(rows, settle=True)
    wanted = shared.select("tid").distinct()
    kept = saved(texts.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]))
    second = kept.select(F.col("tid").alias("ptid"), F.col("text").alias("ptext"))
    pairs = saved(shared.where("tid != ptid").select("tid", "ptid").distinct())
    forget(shared, keep=True, settle=True)

    def verify(some: DataFrame) -> DataFrame:
        return _verify(some.join(kept, "tid").join(second, "ptid"))

    return _among_rest(shared, saved(verify(pairs)), kept, pairs, verify)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start, source_end),
    one row for each repeated passage that was found; copies of a whole text of
    ``WORDS`` words or more are rows of their own."""
    ids = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", text_id().alias("tid"), "text")
    first = ids.groupBy("tid").agg(F.min("doc_id").alias("first_id"))
    spans = repeated_spans(docs)
    source = first.select(F.col("tid").alias("ptid"), F.col("first_id").alias("source_doc_id"))
    passages = (spans.join(first, "tid").join(source, "ptid")
                .select(F.col("first_id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                        "source_doc_id", F.col("pstart").alias("source_start"), F.col("pend").alias("source_end")))
    n = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    sized = ids.select("doc_id", "tid", n.alias("n")).where(F.col("n") >= WORDS)
    copies = (sized.join(first, "tid").where("doc_id != first_id").distinct()
              .select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"),
                      F.col("first_id").alias("source_doc_id"), F.lit(0).alias("source_start"), F.col("n").alias("source_end")))
    return passages.unionByName(copies)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages: further copies of a text of
    ``WORDS`` words or more go, repeated spans are cut out of the others (the
    white space after a span goes with it), and a text that loses all its words
    goes. Rows without repeats are unchanged."""
    spans = (repeated_spans(docs).groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("_rep_cut"))  # of one text
             .withColumnRenamed("tid", "_rep_tid"))
    n = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    tagged = docs.withColumns({"_rep_tid": text_id()})
    first = (tagged.where("text IS NOT NULL").groupBy(F.col("_rep_tid").alias("_rep_t"))
             .agg(F.min("doc_id").alias("_rep_first"), F.count(F.lit(1)).alias("_rep_copies")).where("_rep_copies > 1"))
    joined = (tagged.join(first, F.col("_rep_tid") == F.col("_rep_t"), "left")
              .where(F.col("_rep_t").isNull() | F.col("text").isNull() | (F.col("doc_id") == F.col("_rep_first")) | F.col("_rep_first").isNull() | (n < WORDS))
              .join(spans, "_rep_tid", "left"))
    names = docs.columns
    own = joined.select(*names, "_rep_cut")
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            cuts, out, keep = batch.column("_rep_cut").to_pylist(), batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            hit = [i for i, c in enumerate(cuts) if c and out[i] is not None]
            if hit:
                part = pa.array([out[i] for i in hit], pa.large_string())
                row, a, _, _ = textvec.words(part)
                raw, ends = textvec.buffer(part)
                first_word = np.searchsorted(row, np.arange(len(hit) + 1))
                for k, i in enumerate(hit):
                    starts = np.append(a[first_word[k]:first_word[k + 1]], ends[k + 1])
                    stay = np.ones(ends[k + 1] - ends[k], bool)
                    words_left = np.ones(len(starts) - 1, bool)
                    for c in cuts[i]:
                        x, y = min(c["start"], len(starts) - 1), min(c["end"], len(starts) - 1)
                        stay[starts[x] - ends[k]:starts[y] - ends[k]] = False
                        words_left[x:y] = False
                    out[i] = raw[ends[k]:ends[k + 1]][stay].tobytes().decode()
                    keep[i] = words_left.any()
            columns = [batch.column(j) for j in range(len(names))]
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return own.mapInArrow(run, docs.schema)
