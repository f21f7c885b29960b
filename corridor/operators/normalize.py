"""Raw product-level flows -> conformed section-level flow fact.

One distributed job: scan all years at once, map product -> section and code
-> name with broadcast dimensions, keep covered countries, aggregate with a
map-side partial sum, round half-even, and offer the wide (pivoted) view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import to_money
from ..functions.text import fix_mojibake
from ..schemas import WIDE_VALUE_TYPE
from .joins import small, unique

KEYS = ["year", "exporter", "importer"]


def chapter_sections(sections: DataFrame) -> DataFrame:
    """D3 (section, chapters[]) -> (chapter, category), one row per chapter (S3).

    A chapter in two sections raises: its trade would count twice (the settings reader keeps the
    last section that lists it).
    """
    return unique(sections.select(F.explode("chapters").alias("chapter"), "category"), ["chapter"], "sections of a chapter")


def chapter_coverage(raw: DataFrame, sections: DataFrame) -> DataFrame:
    """Product chapters present in the raw flows, their section (null when unmapped) and line counts."""
    return (
        raw.select(F.substring("k", 1, 2).alias("chapter"))
        .groupBy("chapter").agg(F.count(F.lit(1)).alias("n_lines"))
        .join(small(chapter_sections(sections)), "chapter", "left")
        .select("chapter", "category", "n_lines")
    )


def country_names(country_codes: DataFrame, covered: DataFrame) -> DataFrame:
    """code -> repaired display name, restricted to covered countries.

    ``covered`` has a ``country`` column of names; unknown codes and countries
    outside the coverage list disappear, as both endpoints must be covered. A
    code with two names raises: its trade would count twice (the code list's
    reader keeps the last row of a code).
    """
    names = unique(country_codes.select(
        F.col("country_code").alias("code"), fix_mojibake("country_name").alias("name")
    ), ["code"], "names of a code")
    # a semi join never duplicates rows, so the coverage list needs no distinct
    return names.join(small(covered.select(F.col("country").alias("name"))), "name", "left_semi")


def build_flows(raw: DataFrame, sections: DataFrame, country_codes: DataFrame, covered: DataFrame,
                unit_divisor: int = 1000) -> DataFrame:
    """Long flow fact ``(year, exporter, importer, category, value)``.

    raw: ``t, i, j, k, v`` (value in thousands); output value is in millions,
    banker's-rounded to 2 dp after summing, as DECIMAL(18,2). Products whose
    chapter has no section are dropped (a pandas group-by drops null keys).
    """
    chapters = small(chapter_sections(sections))
    names = small(country_names(country_codes, covered))
    exp = names.select(F.col("code").alias("i"), F.col("name").alias("exporter"))
    imp = names.select(F.col("code").alias("j"), F.col("name").alias("importer"))
    mapped = (
        raw.select(
            F.col("t").cast("int").alias("year"),
            "i",
            "j",
            F.substring("k", 1, 2).alias("chapter"),
            F.col("v").alias("value"),
        )
        .join(chapters, "chapter", "inner")   # unmapped chapter -> null key -> dropped
        .join(exp, "i", "inner")              # exporter must be covered
        .join(imp, "j", "inner")              # importer must be covered
    )
    return (
        mapped.groupBy("year", "exporter", "importer", "category")
        .agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))   # all-null sums to 0, as in pandas
        .select("year", "exporter", "importer", "category",
                to_money(F.col("total"), unit_divisor).alias("value"))
    )


def to_wide(flows: DataFrame, categories: Sequence[str], value_type=WIDE_VALUE_TYPE) -> DataFrame:
    """Long -> wide: one row per (year, exporter, importer), one column per category (A2).

    The explicit category list keeps every column even when a category never
    occurs; absent cells are null. One aggregate does it in one shuffle, and a
    cell that several rows claim raises, as does a value too wide for its type.
    """
    cats = list(categories)

    def cell(c: str):
        mine = F.when(F.col("category") == c, F.col("value"))
        several = F.count(F.when(F.col("category") == c, F.lit(1))) > 1
        return F.when(several, F.raise_error(F.lit(f"several rows for one cell of {c}")).cast(value_type)).otherwise(
            F.max(mine).cast(value_type)).alias(c)

    wide = flows.groupBy(*KEYS).agg(*[cell(c) for c in cats])
    return wide.withColumn("year", F.col("year").cast("smallint"))


def to_long(wide: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Wide -> long, null cells excluded (A3, F18). A single category is a filter."""
    cats = list(categories) if categories else [c for c in wide.columns if c not in KEYS]
    return (
        wide.unpivot(KEYS, cats, "category", "value")
        .where(F.col("value").isNotNull())
        .select(F.col("year").cast("int").alias("year"), "exporter", "importer", "category", "value")
    )


def duplicate_keys(flows: DataFrame) -> DataFrame:
    """Rows whose (year, exporter, importer, category) is not unique; pivot would reject them."""
    return flows.groupBy(*KEYS, "category").count().where(F.col("count") > 1)
