"""Ranks and running totals inside groups of any size, with built-in functions alone.

No task ever holds a whole group: ranks come from range partitions numbered where they lie and
offset by the rows of the group in earlier partitions; running totals are taken within blocks of
bounded size, and over one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corridor.llm.shared import written

#: Rows of the offset table up to which it is broadcast (some tens of bytes each).
OFFSETS = 200_000
#: Steps of one block of a running total.
STRIDE = 4096
#: Low bits of monotonically_increasing_id(): the row's place in its partition.
_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, group: str, order: list[str], folder: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... inside ``group`` by ``order``, nulls first) and ``size`` (rows of the group).

    ``group`` is never null. Rows equal in ``order`` are ranked in some order; they are dealt by their
    place in the input too, so that any number of them spreads over the partitions. The sorted
    rows are written to ``folder``, which fixes the ranks however often tasks run again.
    """
    keys = [group, *order, "_place"]
    # written first: range bounds come from a sample of the rows, which would compute them once more
    df = written(df.withColumn("_place", F.monotonically_increasing_id()), f"{folder}/rows")
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}), f"{folder}/sorted")
    parts = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a group has a row per partition at most
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size")), f"{folder}/offsets")
    if parts.count() <= OFFSETS:
        parts = F.broadcast(parts)
    return placed.join(parts, ["_part", group]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def running(df: DataFrame, group: str, at: str, totals: dict[str, tuple[Callable[[Column], Column], Column, Column]], backwards: bool = False) -> DataFrame:
    """``df`` with the totals of the group's rows before each row (after it, if ``backwards``).

    ``totals``: name -> (aggregate, column, total of no rows); the aggregate is associative and
    commutative, and combines its own results (sum, bit_xor). ``at`` numbers the group's rows
    from 0. Blocks of ``STRIDE`` rows have a total each, so the longest window runs over the
    group's rows / ``STRIDE``.
    """
    def beside(window, name: str) -> Column:
        how, _, none = totals[name]
        return F.coalesce(how(F.col(f"_{name}")).over(window.rowsBetween(Window.unboundedPreceding, -1)), none)

    turn = (lambda c: F.col(c).desc()) if backwards else F.col
    df = df.withColumn("_block", F.floor(F.col(at) / STRIDE)).withColumns({f"_{n}": column for n, (_, column, _) in totals.items()})
    blocks = df.groupBy(group, "_block").agg(*(how(F.col(f"_{n}")).alias(f"_{n}") for n, (how, _, _) in totals.items()))
    outer = Window.partitionBy(group).orderBy(turn("_block"))
    blocks = blocks.select(group, "_block", *(beside(outer, n).alias(f"_far_{n}") for n in totals))
    inner = Window.partitionBy(group, "_block").orderBy(turn(at))
    df = df.withColumns({f"_near_{n}": beside(inner, n) for n in totals}).join(blocks, [group, "_block"])

    def both(n: str) -> Column:
        pair = (F.col(f"_near_{n}"), F.col(f"_far_{n}"))
        return pair[0].bitwiseXOR(pair[1]) if totals[n][0] is F.bit_xor else pair[0] + pair[1]

    return df.withColumns({n: both(n) for n in totals}).drop("_block", *(f"{p}_{n}" for p in ("", "_near", "_far") for n in totals))
