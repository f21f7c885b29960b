"""The flow ETL with its rejects, from one pass.

Every raw row is either kept or rejected for its first reason. Both kinds go through one
aggregate, kept rows by the fact's keys and rejected rows by their raw keys, and are written by
one job, partitioned by reason. ``DataFrame.observe`` counts the rows on the way in, so a job
reports its own accounting without a second scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.measures import to_money
from .joins import small
from .normalize import chapter_sections, country_names

KEPT = "kept"
#: Reasons in the order they are tested.
REASONS = ("unmapped product", "uncovered exporter", "uncovered importer")
FACT_KEYS, RAW_KEYS = ("exporter", "importer", "category"), ("i", "j", "chapter")


def labelled(raw: DataFrame, sections: DataFrame, country_codes: DataFrame, covered: DataFrame) -> DataFrame:
    """(reason, year, exporter, importer, category, i, j, chapter, value): fact keys of kept rows, raw keys of rejected ones."""
    names = small(country_names(country_codes, covered))
    rows = (
        raw.select(F.col("t").cast("int").alias("year"), "i", "j", F.substring("k", 1, 2).alias("chapter"), F.col("v").alias("value"))
        .join(small(chapter_sections(sections)), "chapter", "left")
        .join(names.select(F.col("code").alias("i"), F.col("name").alias("exporter")), "i", "left")
        .join(names.select(F.col("code").alias("j"), F.col("name").alias("importer")), "j", "left")
    )
    tested = zip(REASONS, ("category", "exporter", "importer"), strict=True)
    reason = F.lit(KEPT)
    for name, column in reversed(list(tested)):
        reason = F.when(F.col(column).isNull(), F.lit(name)).otherwise(reason)
    rows = rows.withColumn("reason", reason)
    kept = F.col("reason") == KEPT
    return rows.select("reason", "year", *(F.when(kept, F.col(c)).alias(c) for c in FACT_KEYS), *(F.when(~kept, F.col(c)).alias(c) for c in RAW_KEYS), "value")


def audited(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """``labelled`` rows summed by their keys; ``seen`` gets the counts and values of all rows and of the kept ones."""
    if seen is not None:
        kept = F.col("reason") == KEPT
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("rows_in"), F.count(F.when(kept, F.lit(1))).alias("rows_kept"),
            *(F.count(F.when(F.col("reason") == r, F.lit(1))).alias(f"rows {r}") for r in REASONS),
            F.sum("value").alias("value_in"), F.sum(F.when(kept, F.col("value"))).alias("value_kept"))
    return rows.groupBy("reason", "year", *FACT_KEYS, *RAW_KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


@dataclass
class Build:
    """A written build: the fact, the rejects, and what the job counted while it ran.

    ``seen`` may count rows twice if tasks run again; the written rows never do (``accounting``).
    """

    flows: DataFrame
    rejects: DataFrame
    seen: dict
    rows: DataFrame


def write_audited(raw: DataFrame, sections: DataFrame, country_codes: DataFrame, covered: DataFrame, path: str, unit_divisor: int = 1000) -> Build:
    """One job: fact rows and rejects under ``path``, a folder per reason."""
    seen = Observation("flow etl")
    rows = audited(labelled(raw, sections, country_codes, covered), seen)
    rows.write.option("compression", "snappy").partitionBy("reason").parquet(path)
    back = raw.sparkSession.read.schema(rows.schema).parquet(path)
    flows = back.where(F.col("reason") == KEPT).select("year", *FACT_KEYS, to_money(F.col("total"), unit_divisor).alias("value"))
    rejects = back.where(F.col("reason") != KEPT).select("reason", "year", *RAW_KEYS, "n_rows", F.col("total").alias("value"))
    # of no rows the plan is empty, and nothing is observed
    counted = dict(seen.get) if back.limit(1).count() else {"rows_in": 0, "rows_kept": 0, **{f"rows {r}": 0 for r in REASONS}, "value_in": None, "value_kept": None}
    return Build(flows, rejects, counted, back)


def accounting(build: Build) -> DataFrame:
    """One row, as of ``quality.etl_audit``, from the written rows alone."""
    def n(reason: str | None = None):
        c = F.col("n_rows") if reason is None else F.when(F.col("reason") == reason, F.col("n_rows"))
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    def value(condition=None):
        c = F.col("total") if condition is None else F.when(condition, F.col("total"))
        return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")

    kept = F.col("reason") == KEPT
    return build.rows.agg(
        n().alias("rows_in"), n(KEPT).alias("rows_kept"), *(n(r).alias(a) for r, a in zip(REASONS, ("rows_unmapped", "rows_bad_exporter", "rows_bad_importer"), strict=True)),
        value().alias("value_in"), value(kept).alias("value_kept"), value(~kept).alias("value_rejected"))
