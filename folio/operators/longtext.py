"""Markdown files of any size as rows of lines.

The fence state of a line is 0 outside of code, 1 inside of backticks, 2
inside of tildes. A marker line ``c`` turns state ``x`` into ``(c - x) mod
3``: it opens from 0, closes its own kind and leaves the other kind alone.
So the state after the i-th marker is ``(-1)^i * sum((-1)^j * c_j) mod 3``,
a running sum: blocks of lines are summed by themselves, and what one hands
to the next is a window over block summaries. No row or task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import digest
from folio.functions.text import split_lines_expr
from folio.operators.markdown import _PY_LSTRIP, HEADING_RE
from folio.session import materialize

#: Lines that one window spans.
BLOCK = 4096


def read_lines(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """S10 for files larger than a row: ``key, pos, line`` with 0-based
    positions on Python line boundaries. ``key`` is a partition column of the
    folder, whose files in name order are one text (what ``write_book``
    leaves); without it each file is a text by its path. A piece of a file is
    counted where it is read; only the counts are summed up. Bytes after the
    last newline that end in another line boundary give an empty last line."""
    text = F.concat("value", F.lit("\n"))
    seen = spark.read.option("lineSep", "\n").text(path).select(
        (F.col(key) if key else F.col("_metadata.file_path")).alias("_key"), F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_piece"), F.posexplode(split_lines_expr(text)).alias("_sub", "line"))
    seen = materialize(seen.withColumn("_at", digest.place()))
    place = ["_key", "_file", "_piece"]
    before = Window.partitionBy("_key").orderBy("_file", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (seen.groupBy(*place).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .select(*[F.col(c).alias(f"_of{c}") for c in place], "_first", "_before"))
    same = F.lit(True)
    for c in place:
        same &= F.col(c).eqNullSafe(F.col(f"_of{c}"))
    return seen.join(sizes, same).select(F.col("_key").alias(key or "path"), (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "line")


def _running(lines: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over a text's lines up to this one, from
    sums inside of blocks and a window over the blocks' sums."""
    rows = lines.withColumn("_block", F.floor(F.col("pos") / BLOCK)).withColumn("_value", value)
    before = Window.partitionBy("_sum_key").orderBy("_sum_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(F.col(key).alias("_sum_key"), F.col("_block").alias("_sum_block")).agg(F.sum("_value").alias("_own"))
             .select("_sum_key", "_sum_block", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_carry")))
    so_far = Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(carry, F.col(key).eqNullSafe(F.col("_sum_key")) & (F.col("_block") == F.col("_sum_block")))
            .withColumn(out, (F.sum("_value").over(so_far) + F.col("_carry")).cast("bigint"))
            .drop("_block", "_value", "_sum_key", "_sum_block", "_carry"))


def _marker() -> Column:
    """1 for a line that begins with three backticks, 2 for tildes, else 0."""
    first = F.substring(F.regexp_replace("line", _PY_LSTRIP, ""), 1, 3)
    return F.when(first == "```", 1).when(first == "~~~", 2).otherwise(0)


def fenced_lines(lines: DataFrame, key: str) -> DataFrame:
    """T2 on rows ``key, pos, line``: adds ``before`` and ``after``, the fence
    states around the line, and ``in_code`` (marker lines included). A null
    line is an empty one."""
    rows = _running(lines.withColumn("_c", _marker()), key, F.when(F.col("_c") > 0, 1).otherwise(0), "_i")
    sign = F.when(F.col("_i") % 2 == 0, 1).otherwise(-1)
    rows = _running(rows, key, sign * F.col("_c"), "_alternating")
    after = F.pmod(sign * F.col("_alternating"), F.lit(3))
    rows = rows.withColumn("after", after.cast("int"))
    # a marker's map is its own inverse
    rows = rows.withColumn("before", F.when(F.col("_c") > 0, F.pmod(F.col("_c") - F.col("after"), F.lit(3))).otherwise(F.col("after")).cast("int"))
    return rows.withColumn("in_code", (F.col("before") > 0) | (F.col("after") > 0)).drop("_c", "_i", "_alternating")


def fence_spans_of_lines(lines: DataFrame, key: str) -> DataFrame:
    """``key, s, e`` (``e`` null when the code runs to the end). The k-th
    opening line of a text belongs to its k-th closing one."""
    rows = fenced_lines(lines, key)
    opens = (F.col("before") == 0) & (F.col("after") > 0)
    closes = (F.col("before") > 0) & (F.col("after") == 0)
    marks = materialize(_running(rows, key, opens.cast("int"), "k").where(opens | closes).select(key, "k", "pos", opens.alias("opens")))
    ends = marks.where("NOT opens").select(F.col(key).alias("_key"), F.col("k").alias("_k"), F.col("pos").alias("e"))
    return (marks.where("opens").join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("k") == F.col("_k")), "left")
            .select(key, F.col("pos").alias("s"), "e"))


def _level() -> Column:
    """Hashes of an ATX heading outside of code, else null."""
    return F.when(~F.col("in_code") & F.col("line").rlike(HEADING_RE), F.length(F.regexp_extract("line", HEADING_RE, 2)))


def demote_lines(lines: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """T3 on rows: ``key, pos, line`` with ``levels`` more hashes (up to 6)."""
    marks = F.repeat(F.lit("#"), F.least(_level() + levels, F.lit(6)))
    line = F.when(_level().isNotNull(), F.concat(F.regexp_extract("line", HEADING_RE, 1), marks, F.regexp_extract("line", HEADING_RE, 3)))
    return fenced_lines(lines, key).select(key, "pos", line.otherwise(F.col("line")).alias("line"))


def chapter_lines(lines: DataFrame, key: str, level: int = 2) -> DataFrame:
    """S13 on rows: ``key, pos, line, chapter_no, title`` -- chapters begin at
    headings of up to ``level``; 0 is what comes before the first. ``title`` is
    set on the line that begins a chapter."""
    rows = fenced_lines(lines, key)
    begins = F.coalesce(_level() <= level, F.lit(False))
    title = F.when(begins, F.trim(F.regexp_extract("line", HEADING_RE, 3)))
    return (_running(rows.withColumn("title", title), key, F.col("title").isNotNull().cast("int"), "chapter_no")
            .select(key, "pos", "line", "chapter_no", "title"))
