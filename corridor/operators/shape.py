"""Result shaping: ranking, long/wide reshapes, gap detection, limits, bar geometry.

Inputs are query results, whose size is bounded by the dimensions (partners x
categories x years), never by the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

FLOW_COLUMNS = ("imports", "exports", "balance")


def rank_table(df: DataFrame, flow: str, key: str, k: int | None = None) -> DataFrame:
    """Rows of one flow as (key, <flow>, rank), biggest first.

    Exports rank descending, imports (negative) ascending, i.e. the largest
    magnitude first either way; ties break on the key so ranks are stable.
    ``k`` keeps the top k (a top-k report: per-partition candidates, then the
    best k). Without ``k`` the ranking is distributed: rows are range
    partitioned in rank order and checkpointed with their range (the bounds are
    sampled, so they must be drawn once), numbered inside each range, and each
    range is offset by the row count of the ranges before it.
    """
    order = [F.desc_nulls_last(flow) if flow == "exports" else F.asc_nulls_last(flow), F.asc(key)]
    rows = df.where(F.col("flow") == flow).select(key, F.col("value").alias(flow))
    if k is not None:
        top = rows.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(df.sparkSession)
    parts = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    local = parts.withColumn("_pos", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # one row per range partition: the preceding ranges' sizes give each range its offset
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").select(
        key, flow, (F.col("_offset") + F.col("_pos")).cast("int").alias("rank"))


def table_single(df: DataFrame) -> DataFrame:
    """Single-partner matrix: category and the three flows, by exports descending."""
    return df.select("category", *FLOW_COLUMNS).orderBy(F.desc_nulls_last("exports"))


def series_long(df: DataFrame, key: str = "year") -> DataFrame:
    """(key, partner, imports, exports, balance) -> (key, date, partner, flow, value), nulls dropped."""
    long = df.unpivot([key, "partner"], list(FLOW_COLUMNS), "flow", "value").where(F.col("value").isNotNull())
    return long.select(key, F.make_date(F.col(key), F.lit(1), F.lit(1)).alias("date"), "partner", "flow", "value")


def series_points(long: DataFrame, flow: str | None = None, nonzero: bool = False,
                  flows: tuple[str, ...] | None = None) -> DataFrame:
    """Points to draw from ``series_long`` output: one flow, a set of flows, non-zero only."""
    out = long
    if flow is not None:
        out = out.where(F.col("flow") == flow)
    if flows is not None:
        out = out.where(F.col("flow").isin(list(flows)))
    if nonzero:
        out = out.where(F.col("value") != 0)
    return out


def series_flags(df: DataFrame, value: str = "balance") -> DataFrame:
    """Per partner: does the series break (a null between non-nulls), and is it a single point.

    Ordered by year with a null year last, as the series is drawn.
    """
    w = Window.partitionBy("partner").orderBy(F.asc_nulls_last("year"))
    seen = F.when(F.col(value).isNotNull(), F.lit(1))
    before = F.max(seen).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(seen).over(w.rowsBetween(1, Window.unboundedFollowing))
    gap = F.col(value).isNull() & before.isNotNull() & after.isNotNull()
    return (
        df.select("partner", gap.alias("gap"), F.col(value).alias("v"))
        .groupBy("partner")
        .agg(F.bool_or("gap").alias("has_break"), (F.count("v") == 1).alias("single_value"))
    )


def partner_pivot(df: DataFrame, flow: str, partners: Sequence[str], key: str = "category") -> DataFrame:
    """One row per key, one column per partner holding ``flow``; absent -> null."""
    return df.groupBy(key).pivot("partner", list(partners)).agg(F.first(flow)).orderBy(key)


def table_limits(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Global (min_value, max_value) over every numeric cell; nulls if there are none."""
    num = columns or [f.name for f in df.schema.fields
                      if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    if not num:
        return df.agg(F.lit(None).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"))
    mins = [F.min(c).cast("double") for c in num]
    maxs = [F.max(c).cast("double") for c in num]
    return df.agg(
        (F.least(*mins) if len(mins) > 1 else mins[0]).alias("min_value"),
        (F.greatest(*maxs) if len(maxs) > 1 else maxs[0]).alias("max_value"),
    )


def bar_share(df: DataFrame, column: str) -> DataFrame:
    """Bar width (% of the range, capped at 100) and zero position for each row.

    The limits are scalar subqueries over the same table: computed once,
    no join. A zero range gives nulls.
    """
    lim = table_limits(df, [column])
    lo = lim.select("min_value").scalar()
    hi = lim.select("max_value").scalar()
    rng = F.nullif(F.abs(hi) + F.abs(lo), F.lit(0.0))
    return df.select(
        "*",
        F.least(F.lit(100.0), F.lit(100.0) * F.abs(F.col(column)) / rng).alias("bar_width"),
        (F.abs(lo) / rng).alias("zero_position"),
    )
