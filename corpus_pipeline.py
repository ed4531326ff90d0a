"""The corpus pipeline: operators of ``folio.llm`` as stages over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common, op3_toxicity, op4_jaccard, op6_bpe, op7_substrings, op10_raking, queries


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel classifier doesn't reject. Rows that
    share a doc_id are judged one by one, by the text that was scored."""
    return op3_toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that with the smallest doc_id
    (a null one comes last); rows without shingles stay. Rows are joined by text
    hash, as rows of one doc_id may have different texts."""
    tagged = docs.withColumn("_copy_tid", F.xxhash64("text")).where("text IS NOT NULL")
    found = common.saved(op4_jaccard.near_duplicates(tagged.select(F.col("_copy_tid").alias("doc_id"), "text")).where("n_shingles > 0")
                         .select(F.col("doc_id").alias("_copy_tid"), F.col("component_id").alias("_copy_of")).distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_copy_tid").alias("tid"))
    ids = tagged.groupBy("doc_id", "_copy_tid").agg(F.count(F.lit(1)).alias("n")).join(found, "_copy_tid")
    best = ids.groupBy("_copy_of").agg(F.min_by(F.struct("n", rank.alias("rank")), rank).alias("_copy_best"))
    marks = common.saved(found.join(best, "_copy_of"))
    joined = (docs.withColumn("_copy_tid", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).join(marks, "_copy_tid", "left")
              .where(F.col("_copy_of").isNull() | ((F.col("_copy_tid") == F.col("_copy_best.rank.tid"))
                                                   & F.col("doc_id").eqNullSafe(F.col("_copy_best.rank.id")))))
    if not marks.where("_copy_best.n > 1").limit(1).count():
        return joined.select(*docs.columns)
    once = joined.where("_copy_best.n > 1").dropDuplicates(["_copy_of"])  # repeated rows
    return joined.where("_copy_of IS NULL OR _copy_best.n = 1").unionByName(once).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier text has."""
    out = op7_substrings.drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the raked mix samples them: a row for each copy, so
    that the output's tokens meet the raked marginals."""
    own = [c for c in docs.columns if not c.startswith("mix_")]
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")
    return op10_raking.mix_documents(docs).where("mix_copies > 0").select(*own, copies).select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids by the public byte-level BPE ranks."""
    return op6_bpe.encode(docs, queries.RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: The learned stages have no SQL form; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written in the shared folder
    and read again as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.saved(docs)
    return docs
