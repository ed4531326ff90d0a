"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors (rows whose vec_id is divisible by ``EVERY``) are a stated query set:
all of them meet all rows, in blocks. Rows are dealt to groups of about
``ROWS``, anchors to groups of about ``ANCHORS``; one task gets a group of each.

Inside a task the anchors of a block are joined by a minimum spanning tree
(Prim). The root scores all candidates. At a child, a candidate ``c`` scores

    parent's score +- |child - parent| * |c|       (Cauchy-Schwarz)

and at most ``|child| * |c|``; only candidates whose interval overlaps the
anchor's window of wanted scores are scored again, the others hand their
interval to the next edge, wider by that edge. The tree changes the work, never
the result.

Steps
1. Positives: the window of an anchor is everything at or above its fifth best
   score so far, among rows of its label.
2. Negatives: the window of an anchor and a positive is ``LOW`` to ``HIGH`` per
   cent of the positive's score, among rows of other labels; its lower end rises
   to the tenth best score so far.
3. Each task returns its best rows of every anchor and positive; Spark merges them.

Definitions
- Rows with a null vec_id, label or vector, or with a null or non-finite
  component, take no part. ``label`` is first shifted, ``(label + 1) % 10``, where
  vec_id is divisible by 7. Components are ``floor(256 * x)``.
- Vectors of different lengths: the shorter one ends in zeros.
- Repeated anchor rows (equal in id, label and vector) are one anchor; rows with
  an anchor's vec_id are never its positives or negatives. Other repeated rows
  count each time. Ties go to the smaller vec_id.
- Scores are exact: sums stay below 2**53 in doubles; larger components are
  scored with Python's integers, and a score beyond 64 bits is an error.
- No rows, no anchors or no candidates give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import saved

#: Anchors are the rows whose vec_id is divisible by it.
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score that a negative's score lies between.
LOW, HIGH = 30, 90
#: Rows and anchors that one task gets, about.
ROWS, ANCHORS = 32_768, 8192
#: Anchors of one tree, and candidates that are bounded at a time.
TREE, CHUNK = 256, 4096
_EXACT = float(1 << 53)


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with shifted labels."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return (vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
            .where(F.forall("embedding", finite))
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")))


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole doubles, zeros behind the shorter ones."""
    n = v.value_lengths().to_numpy(zero_copy_only=False) if len(v) else np.zeros(0, np.int64)
    out = np.zeros((len(v), width))
    out[np.repeat(np.arange(len(v)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy(zero_copy_only=False)
    return np.floor(256 * out)


def _table(group: pa.Table, name: str) -> pa.Array:
    column = group[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column


def spanning_tree(anchors: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, length) of a minimum spanning tree's edges in the order in which
    Prim's method adds them; the root, row 0, is its own parent."""
    left = np.ones(len(anchors), bool)
    near, parent = np.full(len(anchors), np.inf), np.zeros(len(anchors), np.int64)
    out, at = [(0, 0, 0.0)], 0
    left[0] = False
    while left.any():
        d = np.sqrt(((anchors - anchors[at]) ** 2).sum(axis=1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at] = False
        out.append((at, int(parent[at]), float(near[at])))
    return out


def _scores(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return rows @ anchor
    whole = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(r, whole)) for r in rows] or [0], dtype=object)[:len(rows)]


class _Best:
    """The best ``size`` (score, vec_id) of one window."""

    def __init__(self, size: int, low=None, high=None) -> None:
        self.size, self.low, self.high = size, low, high
        self.score, self.vec_id = [], []

    def offer(self, score: np.ndarray, vec_id: np.ndarray) -> None:
        fit = np.ones(len(score), bool)
        if self.low is not None:
            fit &= score >= self.low
        if self.high is not None:
            fit &= score <= self.high
        if len(self.score) == self.size:
            fit &= score >= self.score[-1]
        if fit.any():
            all_ = sorted(zip([-s for s in score[fit].tolist()] + [-s for s in self.score], vec_id[fit].tolist() + self.vec_id))[:self.size]
            self.score, self.vec_id = [-s for s, _ in all_], [i for _, i in all_]

    def window(self) -> tuple[float, float]:
        low = -np.inf if self.low is None else float(self.low)
        if len(self.score) == self.size:
            low = max(low, float(self.score[-1]))
        return low, np.inf if self.high is None else float(self.high)


def _mine(anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, wanted: list[list[_Best]], same: bool,
          rows: np.ndarray, row_ids: np.ndarray, row_labels: np.ndarray) -> int:
    """Offer the rows to the windows of each anchor of one tree; returns how many scores were made."""
    tree, made = spanning_tree(anchors), 0
    peak = max(np.abs(anchors).max(initial=0.0), 1.0) * max(np.abs(rows).max(initial=0.0), 1.0) * max(rows.shape[1], 1)
    exact = peak < _EXACT
    length = np.sqrt((anchors ** 2).sum(axis=1))
    for a in range(0, len(rows), CHUNK):
        part, own_ids, own_labels = rows[a:a + CHUNK], row_ids[a:a + CHUNK], row_labels[a:a + CHUNK]
        norm = np.sqrt((part ** 2).sum(axis=1))
        low, high = np.empty((len(anchors), len(part))), np.empty((len(anchors), len(part)))
        for child, parent, edge in tree:
            if child == parent:
                scored = _scores(part, anchors[child], exact)
                low[child] = high[child] = scored.astype(float)
                if not exact:  # doubles only bound such scores
                    slack = np.abs(low[child]) * 1e-15 + 1
                    low[child], high[child] = low[child] - slack, high[child] + slack
                made += len(part)
            else:
                reach = edge * norm * (1 + 1e-12) + 1e-3
                most = length[child] * norm * (1 + 1e-12) + 1e-3
                low[child], high[child] = np.maximum(low[parent] - reach, -most), np.minimum(high[parent] + reach, most)
            fit = ((own_labels == labels[child]) == same) & (own_ids != ids[child])
            over = np.zeros(len(part), bool)
            for best in wanted[child]:
                least, top = best.window()
                over |= (high[child] >= least - 1 - abs(least) * 1e-12) & (low[child] <= top + 1 + abs(top) * 1e-12)
            at = np.flatnonzero(fit & over)
            if not len(at):
                continue
            if child == parent:
                score = scored[at]
            else:
                score = _scores(part[at] if 2 * len(at) < len(part) else part, anchors[child], exact)
                score = score if len(score) == len(at) else score[at]
                made += len(at)
                if exact:
                    low[child, at] = high[child, at] = score
            score = score.astype(np.int64) if exact else score
            for best in wanted[child]:
                best.offer(score, own_ids[at])
    return made


def _task(same: bool):
    """The work of one task: a group of anchors (with their windows) and a group of rows."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor": [], "place": [], "vec_id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            av, rv = _table(anchors, "v"), _table(rows, "v")
            width = max(int(np.max(x.value_lengths().to_numpy(zero_copy_only=False), initial=0)) for x in (av, rv))
            order = np.lexsort((anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()))  # a tree holds near anchors
            a, r = _matrix(av, width)[order], _matrix(rv, width)
            ids, labels = anchors["vec_id"].to_numpy()[order], anchors["label"].to_numpy()[order]
            keys = [anchors["anchor"][int(k)].as_py() for k in order]
            lists = [anchors["positives"][int(k)].as_py() for k in order]
            windows = [[_Best(POSITIVES)] if same else [_Best(NEGATIVES, -(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in ps] for ps in lists]
            for b in range(0, len(ids), TREE):
                _mine(a[b:b + TREE], ids[b:b + TREE], labels[b:b + TREE], windows[b:b + TREE], same, r, rows["vec_id"].to_numpy(), rows["label"].to_numpy())
            for key, found in zip(keys, windows):
                for place, best in enumerate(found):
                    for s, i in zip(best.score, best.vec_id):
                        for name, value in zip(out, (key, place, i, int(s))):
                            out[name].append(value)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})
    return run


_FOUND = "anchor long, place long, vec_id long, score long"  # place: of the positive among the anchor's


def _met(anchors: DataFrame, rows: DataFrame, n_groups: int, n_blocks: int, same: bool) -> DataFrame:
    """Every group of rows with every group of anchors."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("g", each(n_groups)).groupBy("b", "g")
    right = rows.withColumn("b", each(n_blocks)).groupBy("b", "g")
    return left.cogroup(right).applyInArrow(_task(same), _FOUND)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) of ``vectors(vec_id, embedding, label)``."""
    whole = saved(_integers(vectors))
    n = whole.count()
    n_groups = max(-(-n // ROWS), min(-(-n // 1024), 2 * vectors.sparkSession.sparkContext.defaultParallelism), 1)  # smaller groups keep all cores busy
    rows = whole.withColumn("g", (F.monotonically_increasing_id() % n_groups).cast("int"))  # by place, so no id or vector is hot
    anchors = whole.where(F.col("vec_id") % EVERY == 0).distinct()
    anchors = saved(anchors.withColumn("anchor", F.monotonically_increasing_id()))
    n_blocks = max(-(-anchors.count() // ANCHORS), 1)
    anchors = anchors.withColumn("b", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int"))

    none = F.array().cast("array<struct<vec_id:bigint,score:bigint>>")
    best = _met(anchors.withColumn("positives", none), rows, n_groups, n_blocks, True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    positives = (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POSITIVES)
                 .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("ps"))
                 .select("anchor", F.transform("ps", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("positives")))
    armed = saved(anchors.join(positives, "anchor"))
    found = _met(armed, rows, n_groups, n_blocks, False)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    named = armed.select("anchor", F.col("vec_id").alias("anchor_id"), "positives")
    positive = F.col("positives")[F.col("place").cast("int")]
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).join(named, "anchor")
            .select("anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    positive["score"].alias("positive_score"), F.col("score").alias("negative_score")))
