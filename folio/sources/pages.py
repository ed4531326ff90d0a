"""S1 ``scan_pages`` and S10 ``read_markdown``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas
from folio.sources import files


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Read raw page HTML keyed by URL with the fixed ``pages``
    schema (no inference; column pruning reaches the parquet scan)."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Existing Markdown files as ``doc_id, path, text`` (one row per
    whole file). ``path`` is a folder, read with all below it, or a pattern; a
    folder is listed and read in tasks. ``doc_id`` is a stable hash of the path."""
    return files.read_whole(spark, path).select(F.xxhash64("path").alias("doc_id"), "path", F.col("value").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
