"""Streaming form of the weekly refresh (ST1-ST3).

New page files arrive in a folder; each micro-batch keeps the first
record per URL, drops URLs already in the cache (J1, in the key
buckets of the batch only), extracts the rest and puts them into the
cache (S5). ``trigger(availableNow=True)``
drains what is there and stops; the checkpoint makes replays idempotent
per file, and the anti-join against the cache makes a fresh checkpoint
safe too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio import schemas
from folio.functions import urls
from folio.operators import incremental
from folio.operators.index import dedup_keep_first
from folio.profile import DEFAULT_PROFILE, SiteProfile
from folio.session import dropping_tables, materialize


def stream_dedup(batch: DataFrame, key: str = "url", order: str = "page_id") -> DataFrame:
    """ST2: first record per key inside a batch (earliest ``order``)."""
    return dedup_keep_first(batch, key, [order], part=None)


def _least(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    best = None
    for rows in batches:
        rows = rows if best is None else pd.concat([best, rows], ignore_index=True)
        best = rows.sort_values(order, kind="stable", na_position="first").head(1)
    return best


def first_of_keys(batch: pa.RecordBatch, key: str, order: str) -> pa.RecordBatch:
    """The row with the least ``order`` (null first) of each key of a batch;
    a null key is a key. Only those two columns are looked at, other values
    (whole pages) stay in Arrow and are copied for the chosen rows alone."""
    at = pc.sort_indices(batch.column(order), sort_keys=[("", "ascending")], null_placement="at_start")
    keys = batch.column(key).take(at).dictionary_encode(null_encoding="encode").indices
    return batch.take(at.take(pa.array(np.unique(keys.to_numpy(), return_index=True)[1])))


def dedup_stream(stream: DataFrame, key: str = "url", order: str = "page_id", time: str | None = None, within_ms: int | None = None) -> DataFrame:
    """ST2 across batches: a stream of the first record of each key. The batch
    that has a key first decides, inside of it the least ``order``; ties keep any
    one of the tied rows. The state is one flag a key. With a crawl time column
    a flag ends once the watermark (``within_ms`` late) is ``within_ms`` past the
    key's first record, so state is bounded by that span, and later rows than the
    watermark are dropped; without, it is kept for good. A null key is a key.
    Each Arrow batch is reduced to one row a key before the shuffle, so a hot key
    reaches its task as a row for each batch of its input."""
    schema = stream.schema

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield first_of_keys(batch, key, order)

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = _least(batches, [order])
        if state.exists or best is None:
            return
        state.update((True,))
        if time:
            seen = int(best[time].iloc[0].timestamp() * 1000)
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + within_ms)
        yield best

    rows = stream.mapInArrow(reduce, schema)
    if time:
        rows = rows.withWatermark(time, f"{within_ms} milliseconds")
    ends = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(first, schema, "seen boolean", "append", ends)


def stream_new_pages(spark: SparkSession, in_dir: str, cache_dir: str, checkpoint: str, extract,
                     profile: SiteProfile = DEFAULT_PROFILE):
    """ST1: process new page files into the cache. ``extract(pages) ->
    url, markdown, author, posted_date``. Returns the finished query."""
    src = spark.readStream.schema(schemas.PAGES).parquet(in_dir)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        with dropping_tables(spark):  # the batch's tables go when its records are in the cache
            pages = materialize(stream_dedup(batch))  # read by the extraction and by its joins
            if incremental.has_cache(spark, cache_dir):
                keyed = pages.withColumn("url_key", urls.url_key("url"))
                cache = incremental.read_post_cache(spark, cache_dir, keys=keyed)
                pages = keyed.join(cache.select("url_key"), "url_key", "left_anti").drop("url_key")
            incremental.append_post_cache(extract(pages), cache_dir)

    q = (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def refresh_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """ST3: what changed since the last snapshot."""
    return incremental.snapshot_diff(old, new)
