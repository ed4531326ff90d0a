"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "folio") -> SparkSession:
    """Return a session configured for the folio jobs.

    On a cluster everything (memory, shuffle partitions, checkpoint folder)
    comes from the submit configuration; only a local master (tests, bench)
    gets defaults here. AQE is on by Spark's own default.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = (builder
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
                   .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "16g"))
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if master and master.startswith("local"):
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only
    when the cluster configuration names none (tests, local bench).

    On a cluster ``spark.checkpoint.dir`` must point at shared storage; it
    is read from the session and never overridden here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.startswith("local"):
            conf_dir = tempfile.mkdtemp(prefix="folio-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_written: dict[str, int] = {}  # the tables' paths and the threads that wrote them


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the session's shared checkpoint
    folder (it survives executor loss, and later scans read only the columns
    they need). ``drop_materialized`` removes what a session has written. The
    shuffles that made the table aren't read any more: the driver's garbage
    collection lets Spark delete their files before the next step writes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = threading.get_ident()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete one table that ``materialize`` has returned, once nothing reads it."""
    path = df._table_path
    _delete(df.sparkSession, path)
    del _written[path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written in this process; to
    be called once the results that read them are stored."""
    while _written:
        _delete(spark, _written.popitem()[0])


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that this thread has written inside:
    for work whose result is stored before it ends (a batch of a stream)."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p, who in _written.items() if who == threading.get_ident() and p not in before]:
            del _written[path]
            _delete(spark, path)
