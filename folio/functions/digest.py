"""Order-sensitive digests that merge.

The digest of a sequence of items is the pair of polynomials
``sum(item[i] * BASE ** i)`` modulo a prime, one for each base, over 28-bit
items of the values' MD5, packed into one 62-bit number. Sequences
concatenate as ``left + right * BASE ** size(left)``, so pieces are
digested where they are read and only their sizes and digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

PRIME = 2**31 - 1
BASES = (48_271, 69_621)
_SHIFT = 2**31


def place() -> Column:
    """A row's place in the piece of a file that its task reads, up to a start
    that ``pieces`` takes off."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))


def item(value: Column) -> Column:
    """The two 28-bit items of a text (null: as empty), packed."""
    h = F.md5(F.coalesce(value, F.lit("")))
    part = [F.conv(F.substring(h, at, 7), 16, 10).cast("bigint") for at in (1, 8)]
    return part[0] * _SHIFT + part[1]


def _halves(packed: Column) -> list[Column]:
    return [F.shiftright(packed, 31), packed.bitwiseAND(F.lit(_SHIFT - 1))]


def _pack(halves: list[Column]) -> Column:
    return halves[0] * _SHIFT + halves[1]


def _power(base: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo the prime by the exponent's hexadecimal
    digits (up to 2**36), each looked up in its table of powers."""
    out = None
    for k in range(9):
        table = ",".join(f"{pow(base, d << (4 * k), PRIME)}L" for d in range(16))
        digit = F.shiftright(exponent, 4 * k).bitwiseAND(F.lit(15)).cast("int")
        factor = F.get(F.expr(f"array({table})"), digit)
        out = factor if out is None else (out * factor) % PRIME
    return out


def shifted(packed: Column, by: Column) -> Column:
    """The terms of a digest whose sequence begins at place ``by``."""
    by = by.cast("bigint")
    return _pack([(h * _power(b, by)) % PRIME for h, b in zip(_halves(packed), BASES)])


def _sum(packed: Column) -> Column:
    return _pack([F.sum(h) % PRIME for h in _halves(packed)])


def empty() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("digest"), F.lit(_SHIFT + 1).cast("bigint").alias("unit"))


def append(acc: Column, packed: Column) -> Column:
    """``acc`` (begun by ``empty``) with one more item."""
    unit, old, new = _halves(acc["unit"]), _halves(acc["digest"]), _halves(packed)
    return F.struct((acc["n"] + 1).alias("n"), _pack([(o + x * u) % PRIME for o, x, u in zip(old, new, unit)]).alias("digest"),
                    _pack([(u * b) % PRIME for u, b in zip(unit, BASES)]).alias("unit"))


def pieces(rows: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """``by, n, digest`` of rows with ``_at`` (``place``) and ``_item``, where the
    rows of a key are neighbours in one task. The start of a piece is taken off
    by a power of the inverse base after the sums, so rows need no window."""
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_start"), _sum(shifted(F.col("_item"), F.col("_at"))).alias("_sum"), *aggs)
    back = [(h * _power(pow(b, -1, PRIME), F.col("_start"))) % PRIME for h, b in zip(_halves(F.col("_sum")), BASES)]
    return sums.withColumn("digest", _pack(back)).drop("_sum", "_start")


def merged(parts: DataFrame, by: list[str], order, *aggs: Column) -> DataFrame:
    """``by, n, digest`` of sequences from their parts' in ``order``. The window
    holds the parts of one key: summaries, not items."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return (parts.withColumn("_start", start).groupBy(*by)
            .agg(F.sum("n").cast("bigint").alias("n"), _sum(shifted(F.col("digest"), F.col("_start"))).alias("digest"), *aggs))
