"""Fact layout clustered on both ends of a flow: importer filters skip pages as exporter filters do.

Names get dense codes in their own order; the bits of a row's exporter and importer codes are
interleaved (a Z-order curve), and rows are range-partitioned and sorted by year and that key.
Rows next to each other then share a small square of exporters x importers, so the minima and
maxima of both columns are tight in every page, and the reader's column index leaves out the
pages that a filter on either end can't match. A layout sorted by one end alone spreads each
value of the other end over all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import DIM_ROW_LIMIT, is_small

#: Rows of a page, the unit that the reader skips.
PAGE_ROWS = 2000


def dense_codes(names: DataFrame, column: str) -> DataFrame:
    """(name, code): 0, 1, ... in the order of the names. For a dimension whose size is checked."""
    one = names.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    if not is_small(one, DIM_ROW_LIMIT):
        raise ValueError(f"more than {DIM_ROW_LIMIT} names to cluster by")
    return one.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("code"))


def interleaved(a: Column, b: Column, bits: int) -> Column:
    """The bits of a and b in turn, a's before b's; places on a Z-order curve."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for x, at in ((a, 2 * i + 1), (b, 2 * i)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), at))
    return out


def clustered(flows: DataFrame, codes: DataFrame) -> DataFrame:
    """``flows`` range-partitioned by year and curve, sorted inside; rows with an unknown end come first."""
    n = codes.count()
    bits = max(1, (n - 1).bit_length()) if n else 1
    if 2 * bits > 62:
        raise ValueError("too many names for one key")
    ends = [F.broadcast(codes.select(F.col("name").alias(end), F.col("code").alias(f"_{end}"))) for end in ("exporter", "importer")]
    z = F.coalesce(interleaved(F.col("_exporter"), F.col("_importer"), bits), F.lit(-1).cast("long"))
    keyed = flows.join(ends[0], "exporter", "left").join(ends[1], "importer", "left").withColumn("_z", z)
    placed = keyed.repartitionByRange("year", "_z").sortWithinPartitions("year", "_z", "exporter", "importer", "category")
    return placed.select(*flows.columns)


def write_clustered(flows: DataFrame, path: str, names: DataFrame, column: str = "country", mode: str = "errorifexists", page_rows: int = PAGE_ROWS,
                    partitions: str = "static") -> None:
    """The long fact as snappy Parquet by year, clustered on both ends; ``names``: a dimension that holds every end.

    ``partitions="dynamic"`` with mode ``overwrite`` replaces the written years alone.
    """
    (
        clustered(flows, dense_codes(names, column))
        .write.mode(mode)
        .option("partitionOverwriteMode", partitions)
        .option("compression", "snappy")
        .option("parquet.page.row.count.limit", page_rows)
        .partitionBy("year")
        .parquet(path)
    )
