"""Stateful first-record streams (ST2)."""

import datetime as dt

from folio.streaming import refresh

SCHEMA = "url string, page_id long, html string, at timestamp"


def feed(spark, root, batches, **kw):
    """One run of the stream for each batch, with the state between them."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/*")
        (refresh.dedup_stream(stream, **kw).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/run").trigger(availableNow=True).start().awaitTermination())
    return sorted((str(r.url), r.page_id, r.html) for r in spark.read.schema(SCHEMA).parquet(f"{root}/out").collect())


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_earlier_batches_win(spark, tmp_path):
    got = feed(spark, tmp_path, [
        [("a", 5, "x", at(0)), ("a", 3, "y", at(1)), (None, 9, "n", None)],
        [("a", 1, "late", at(2)), ("b", 2, None, at(2)), (None, 1, "m", at(2))],
        [("b", 1, "again", at(3))]])
    assert got == [("None", 9, "n"), ("a", 3, "y"), ("b", 2, None)]


def test_state_ends_with_the_watermark(spark, tmp_path):
    minute = 60_000
    got = feed(spark, tmp_path, [
        [("a", 1, "x", at(0))],
        [("a", 2, "soon", at(3)), ("b", 3, "y", at(100))],
        [("c", 4, "z", at(101))],
        [("a", 5, "after", at(102))]], time="at", within_ms=5 * minute)
    assert got == [("a", 1, "x"), ("a", 5, "after"), ("b", 3, "y"), ("c", 4, "z")]
