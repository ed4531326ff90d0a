"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only).

Chat systems often log a conversation again after every exchange, each time
under a new id. A rolling hash of the turns identifies every prefix of a
conversation, an anti-join drops the conversations that are a prefix of a
longer one, and only the maximal ones are rendered.

Definitions
- A conversation is the set of its distinct (turn, role, text) rows, ordered
  by turn, then role, then text (nulls first). Repeated rows count once.
- A is a snapshot of B if B has rows with a later turn than A's last, and B's
  rows up to that turn equal A's. Null turns sort before all others.
- Of equal conversations the smallest conv_id stays (a null id before others).
- Null roles render as ``unknown``, null texts as empty. Rows with a null
  conv_id form one conversation. Other columns are ignored.

The hash of a prefix is the XOR of two independent 64-bit hashes of its rows,
each of which holds its turn; XOR is what makes it a sum over blocks of turns:
a conversation of any length is summed in blocks of ``BLOCK`` turns, and only
block totals meet in a window over the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: The chat template; a null or odd role is rendered as it is written here.
START, END = "<|im_start|>", "<|im_end|>\n"


def _row_hash(seed: int):
    cols = [x for c in ("turn", "role", "text")
            for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(seed), *cols)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) rows with their block of turns."""
    return (conversations.select("conv_id", "turn", "role", "text").distinct()
            .withColumn("part", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).cast("long")))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """One row for each conversation and turn: the number of rows and the two
    hashes of the prefix that ends with the turn, and whether it is the last."""
    turns = (rows.groupBy("conv_id", "part", "turn")
             .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(_row_hash(1)).alias("a"), F.bit_xor(_row_hash(2)).alias("b")))
    inside = (Window.partitionBy("t.conv_id", "t.part").orderBy("t.turn")
              .rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id")
    blocks = (turns.groupBy("conv_id", "part")
              .agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("turn").alias("block_last"))
              .select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                      F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"),
                      F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"),
                      F.max("block_last").over(over).alias("last_turn")))
    t, k = turns.alias("t"), blocks.alias("k")
    return (t.join(k, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("t.part") == F.col("k.part")))
            .select("t.conv_id", "t.turn", "last_turn",
                    (F.sum("n").over(inside) + F.col("n0")).alias("n"),
                    F.bit_xor("a").over(inside).bitwiseXOR(F.col("a0")).alias("a"),
                    F.bit_xor("b").over(inside).bitwiseXOR(F.col("b0")).alias("b"))
            .withColumn("is_last", F.col("turn").eqNullSafe(F.col("last_turn"))).drop("last_turn"))


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no snapshot of another
    one and, among equal ones, have the smallest id."""
    prefixes = prefix_hashes(rows)
    whole = (prefixes.where("is_last").groupBy("n", "a", "b")
             .agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"),
                  F.count(F.lit(1)).alias("n_copies")))
    longer = prefixes.where("NOT is_last").select("n", "a", "b").distinct()
    return (whole.join(longer, ["n", "a", "b"], "left_anti")
            .select(F.col("first.conv_id").alias("conv_id"), F.col("n").alias("n_turns"), "n_copies"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Render the maximal conversations: one row for each conversation and
    block of ``BLOCK`` turn numbers (``part`` 0, 1, ...; concatenated in that
    order they are the whole text), so that no row grows with a conversation."""
    rows = turn_rows(conversations)
    keep = maximal_conversations(rows).withColumnRenamed("conv_id", "kept_id")
    said = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    parts = (rows.join(keep, F.col("conv_id").eqNullSafe(F.col("kept_id")))
             .groupBy("conv_id", "part")
             .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("part_turns"),
                  F.array_join(F.transform(
                      F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("said")))), lambda x: x["said"]), "").alias("rendered")))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    return parts.select("conv_id", "n_turns", "n_copies", number.cast("long").alias("part"), "part_turns", "rendered")
