"""Mixing sources to target weights by iterative proportional fitting
(DataFrame functions only).

Token counts are summed to cells (source, language, topic). The cells' weights
are scaled until their sums over each dimension equal the target marginals;
a document's factor is its cell's weight over the cell's tokens. Documents are
then sampled by that factor: its whole part as sure copies, its fraction as
the probability of one more, decided by a hash of the id.

Definitions
- Tokens are words ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and
  the factor of its cell (0 if the whole cell has no tokens).
- A null source, language or topic is a value of its own.
- Targets default to ``share ** power`` of the corpus's own marginals (power
  below 1 moves weight from large values to small ones), or are given as
  (dimension, value, weight) rows. Values without a target weigh nothing.
- Rows with the same doc_id share one decision; a null doc_id counts as a
  value. Extra columns pass through.
- An empty table gives no rows.

Cells are pre-aggregated before any shuffle, so the fitting handles cells, not
documents; a hot source is a few cells. Each round is cut by a table in the
shared folder, and ends early once all marginals are within ``tolerance``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import saved

DIMS = ("source", "lang", "topic")


def topic_of(text: str = "text") -> Column:
    """A coarse topic by surface form: contact, table, shout, notice or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.contains("@") | t.contains("password="), "contact")
            .when(t.contains(" | "), "table")
            .when(t.contains("!! "), "shout")
            .when(F.lower(t).contains("licen"), "notice")
            .otherwise("prose"))


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def marginal_targets(cells: DataFrame, power: float) -> DataFrame:
    """(dim, value, target): each dimension's tokens shared out by
    ``share ** power``; the targets of a dimension sum to 1."""
    long = reduce(DataFrame.unionByName, [
        cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        .select(F.lit(d).alias("dim"), "value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("w")) for d in DIMS])
    total = long.groupBy("dim").agg(F.sum("w").alias("all"))
    return long.join(total, "dim").select("dim", "value", (F.col("w") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = 50, tolerance: float = 1e-7) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``; weights sum to 1."""
    targets = saved(targets)
    now = saved(cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        nxt = now.withColumn("off", F.lit(0.0))
        for d in DIMS:
            sums = nxt.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("sum"))
            scale = (sums.join(targets.where(F.col("dim") == d).drop("dim").withColumnRenamed("value", "v"),
                               F.col("value").eqNullSafe(F.col("v")), "left")
                     .select("value", (F.coalesce("target", F.lit(0.0)) / F.col("sum")).alias("scale")))
            nxt = (nxt.join(scale, F.col(d).eqNullSafe(F.col("value")))
                   .select(*DIMS, "tokens", (F.col("weight") * F.col("scale")).alias("weight"),
                           F.greatest("off", F.abs(F.col("scale") - 1)).alias("off")))
        now = saved(nxt)
        worst = now.agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            break
    return now.drop("off")


def mix_documents(docs: DataFrame, power: float = 0.7, fraction: float = 1.0, targets: DataFrame | None = None,
                  seed: str = "mix") -> DataFrame:
    """``docs`` with mix_topic, mix_tokens, mix_factor (expected copies: the
    fitted mix times ``fraction`` of the corpus's tokens) and mix_copies (the
    sample). Columns of ``docs`` with a ``mix_`` name are replaced."""
    own = docs.select(*[c for c in docs.columns if not c.startswith("mix_")])
    tagged = own.withColumns({"mix_topic": topic_of(), "mix_tokens": n_tokens()})
    cells = saved(tagged.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")))
    fitted = rake(cells, targets if targets is not None else marginal_targets(cells, power))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    factors = fitted.select(*[F.col(d).alias(f"mix_cell_{d}") for d in DIMS],
                            F.round(F.col("weight") * F.lit(total) / F.col("tokens"), 4).alias("mix_factor"))
    on = (F.col("source").eqNullSafe(F.col("mix_cell_source")) & F.col("lang").eqNullSafe(F.col("mix_cell_lang"))
          & F.col("mix_topic").eqNullSafe(F.col("mix_cell_topic")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    whole = F.floor("mix_factor")
    return (tagged.join(factors, on, "left").drop(*[f"mix_cell_{d}" for d in DIMS])
            .withColumn("mix_factor", F.coalesce("mix_factor", F.lit(0.0)))
            .withColumn("mix_copies", (whole + F.when(u < F.col("mix_factor") - whole, 1).otherwise(0)).cast("int")))
