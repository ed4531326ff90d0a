"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import textvec
from folio.session import ensure_checkpoint_dir

#: Characters of text one vectorised step holds at once inside a task.
CHUNK_CHARS = 400_000
#: Rows of a table of labels that may be broadcast.
FEW = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the session's shared checkpoint folder and
    read it back. It cuts lineage, and the result survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


#: Seconds after which the JVM has let go of what Python dropped.
DETACH_S = 0.6


def forget(*tables: DataFrame, keep: bool = False, settle: bool = False) -> None:
    """Delete tables that ``saved`` has written, once nothing reads them any
    more (not with ``keep``). The driver's garbage collection then lets Spark
    remove the shuffle files of the finished steps too: of all of them with
    ``settle``, which waits until the JVM has let go of them."""
    for df in () if keep else tables:
        path = getattr(df, "_saved_path", None)
        if path:
            jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            del df._saved_path
    if settle:  # what Python drops is let go in the JVM by a thread of its own, a little later
        gc.collect()
        time.sleep(DETACH_S)
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (the contracts' folds)."""
    return F.crc32(doc_id.cast("string")) % n


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``CHUNK_CHARS`` of ``column``
    (one row at least), which bounds what a vectorised step allocates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lens) - lens) // CHUNK_CHARS
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


#: Bits of the bitmaps that tell tasks which hashes are worth a shuffle: 8 MB, whatever the input.
BITS = 1 << 26


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash (uint64) in a bitmap of ``BITS`` bits."""
    h = textvec.mix(h)
    return h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in the first column (long). Its words are made in
    tasks and OR-ed in Spark; ``BITS / 64`` of them reach the driver at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.diff(word, prepend=word[0] + np.uint64(1)))
                own[word[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["word", "bits"])

    got = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the bitmap; none that is in it is missed."""
    out = np.ones(len(h), bool)
    for at in _places(h):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bounded_sample(rows: DataFrame, by: str, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows for each value of ``by``: those with the smallest
    hash of ``key``. The sizes of the groups come from one map-side combined
    count, so that only about ``bound`` rows a group reach the ranking."""
    sizes = saved(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size")))
    if sizes.count() <= FEW:  # so many labels that shuffling by label is needed are no hot keys
        sizes = F.broadcast(sizes)
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = (rows.select(key, by).withColumn("_u", u).join(sizes, by)
            .where(F.col("_u") * F.col("_size") <= 1.2 * bound + 50)
            .selectExpr(f"`{key}`", f"row_number() OVER (PARTITION BY `{by}` ORDER BY _u, `{key}`) AS _rank")
            .where(F.col("_rank") <= bound).select(key))
    return rows.join(near, key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that
    it reaches. Labels take the least label around them and then jump to their
    label's label, round by round, until none changes; rounds grow with the
    logarithm of the longest path. Each round is a table in the shared folder."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    now = saved(both.groupBy("a").agg(F.min("b").alias("low"))
                .select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        near = (both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("low")))
        hooked = now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = saved(hooked.join(jump, "root").select("node", "was", F.least("root", "far").alias("root")))
        changed = nxt.where("was != root").limit(1).count()
        forget(now, *([] if changed else [both]))
        now = nxt
        if not changed:
            return now.select("node", "root")
