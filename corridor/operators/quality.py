"""Data-quality audits: silent drops made visible (L2, ETL accounting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import small
from .normalize import chapter_sections, country_names


def missing_factors(view: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct factor keys the flows need but the factor table lacks (L2).

    Such flows vanish from every converted result; this lists them instead.
    ``view`` carries the keys (e.g. year, reporter), ``factors`` the table.
    """
    need = view.select(*keys).distinct()
    return need.join(small(factors.select(*keys).distinct()), keys, "left_anti")


def etl_audit(raw: DataFrame, sections: DataFrame, country_codes: DataFrame, covered: DataFrame) -> DataFrame:
    """Row and value accounting of the flow ETL in one pass: in = kept + rejected.

    Rejections are counted by first reason: unmapped product chapter, then
    uncovered exporter, then uncovered importer.
    """
    ch = small(chapter_sections(sections).withColumn("_mapped", F.lit(True)))
    names = small(country_names(country_codes, covered).select("code").withColumn("_ok", F.lit(True)))
    t = (
        raw.select("i", "j", F.substring("k", 1, 2).alias("chapter"), "v")
        .join(ch, "chapter", "left")
        .join(names.select(F.col("code").alias("i"), F.col("_ok").alias("_exp_ok")), "i", "left")
        .join(names.select(F.col("code").alias("j"), F.col("_ok").alias("_imp_ok")), "j", "left")
    )
    unmapped = F.col("_mapped").isNull()
    bad_exp = ~unmapped & F.col("_exp_ok").isNull()
    bad_imp = ~unmapped & F.col("_exp_ok").isNotNull() & F.col("_imp_ok").isNull()
    kept = ~unmapped & F.col("_exp_ok").isNotNull() & F.col("_imp_ok").isNotNull()

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    def val(c):
        return F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0)).cast("decimal(38,2)")

    return t.agg(
        F.count(F.lit(1)).alias("rows_in"), cnt(kept).alias("rows_kept"),
        cnt(unmapped).alias("rows_unmapped"), cnt(bad_exp).alias("rows_bad_exporter"),
        cnt(bad_imp).alias("rows_bad_importer"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(38,2)").alias("value_in"), val(kept).alias("value_kept"),
        val(unmapped | bad_exp | bad_imp).alias("value_rejected"),
    )
