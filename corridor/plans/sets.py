"""The single-country report from one pass over the fact: GROUPING SETS over one converted view.

Partners (Q1), categories (Q2) and world trade (Q3) differ in their keys and in which rows they
count, not in the rows they read. One view holds the reporter's rows of both sides; an
aggregate over the sets (counterpart), (category) and (year, reporter) takes each result's rows by a
condition, so the fact is scanned once and one shuffle carries the partial sums of all three.
What is left, at most countries + categories + years x members rows, is aggregated once more,
as the published world trade needs its members first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import out, row_measures, share, signed
from ..params import ALL_CATEGORIES, ALL_COUNTERPARTS, REST_OF_WORLD, Params
from .catalog import Catalog
from .core import converted, gdp_by_year, gdp_total, isin, sided, year_spine

#: grouping_id() of each set over (counterpart, category, year, reporter).
PARTNERS, CATEGORIES, MEMBER_YEARS = 0b0111, 0b1011, 0b1100
KEYS = ("part", "year", "partner", "category")


def _sets(cat: Catalog, p: Params, reporters) -> DataFrame:
    """One row per key of each set: sums and row counts of the three results."""
    amounts = converted(cat, p, sided(cat, p, reporters, ("exports", "imports"), category=None), reporters)
    outside = (F.col("side") == p.flow) & ~isin("counterpart", reporters)
    if p.group != ALL_COUNTERPARTS:
        outside = outside & isin("counterpart", cat.members(p.group))
    chosen = F.lit(True) if p.category == ALL_CATEGORIES else F.col("category") == p.category
    which = {"partner": outside & chosen, "category": outside, "exports": (F.col("side") == "exports") & chosen, "imports": (F.col("side") == "imports") & chosen}
    measures = [m for n, c in which.items() for m in (F.sum(F.when(c, F.col("amount"))).alias(f"sum_{n}"), F.count(F.when(c, F.lit(1))).alias(f"n_{n}"))]
    keys = ["counterpart", "category", "year", "reporter"]
    # the amount's columns share names with the keys: keys are grouped as copies
    view = amounts.withColumns({f"k_{k}": F.col(k) for k in keys})
    cols = [F.col(f"k_{k}") for k in keys]
    grouped = view.groupingSets([[cols[0]], [cols[1]], [cols[2], cols[3]]], *cols)
    return grouped.agg(F.grouping_id().alias("set"), *measures)


def single_report_sets(cat: Catalog, p: Params) -> DataFrame:
    """Q1, Q2 and Q3 (published form) of one request in one table, by ``part``.

    Rows of ``partners`` and ``categories`` have a flow and a value, rows of ``world_trade`` a year
    and its imports, exports and balance. ``parts`` takes the three results apart again.
    """
    reporters = cat.members(p.country)
    s = _sets(cat, p, reporters)
    of = F.col("set")
    part = F.when(of == PARTNERS, "partners").when(of == CATEGORIES, "categories").otherwise("world_trade")
    world = of == MEMBER_YEARS
    exported = F.col("n_exports") > 0
    rows = s.where(((of == PARTNERS) & (F.col("n_partner") > 0)) | ((of == CATEGORIES) & (F.col("n_category") > 0)) | (world & (exported | (F.col("n_imports") > 0))))
    rows = rows.select(
        part.alias("part"),
        # a member's year counts where the member exported (L4)
        F.when(world & exported, F.col("k_year")).cast("int").alias("year"),
        F.when(of == PARTNERS, F.col("k_counterpart")).otherwise(F.lit(REST_OF_WORLD)).alias("partner"),
        F.when(of == CATEGORIES, F.col("k_category")).otherwise(F.lit(p.category)).alias("category"),
        F.when(of == PARTNERS, F.col("sum_partner")).when(of == CATEGORIES, F.col("sum_category")).alias("total"),
        F.when(world & exported, F.col("sum_exports")).alias("exports"),
        F.when(world & (F.col("n_imports") > 0), F.col("sum_imports")).alias("imports"),
    )
    amount = rows.schema["total"].dataType
    spine = year_spine(cat, p.years).select(
        F.lit("world_trade").alias("part"), "year", F.lit(REST_OF_WORLD).alias("partner"), F.lit(p.category).alias("category"),
        *(F.lit(None).cast(amount).alias(c) for c in ("total", "exports", "imports")))
    few = rows.unionByName(spine).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("total", "exports", "imports")))
    if p.is_gdp:
        few = few.join(gdp_by_year(cat, reporters), "year", "left")
    of_world = F.col("part") == "world_trade"
    measured = row_measures(F.col("exports"), F.col("imports"), F.col("gdp") if p.is_gdp else None)
    total = share(F.col("total"), gdp_total(cat, reporters, p.years)) if p.is_gdp else F.col("total")

    def only(condition: Column, c: Column, name: str) -> Column:
        return F.when(condition, c).alias(name)

    few = few.select(*KEYS, total.alias("total"), *measured)
    return few.select(
        "part", F.lit(p.years_label).alias("years"), F.lit(p.country).alias("country"), "year", "partner", "category",
        only(~of_world, F.lit(p.flow), "flow"), only(~of_world, out(signed(F.col("total"), p.flow)), "value"),
        *(only(of_world, F.col(c), c) for c in ("imports", "exports", "balance")), F.lit(p.unit_label).alias("unit"))


def parts(report: DataFrame) -> dict[str, DataFrame]:
    """The three results of a report, with the columns of Q1, Q2 and Q3; persist the report to take it apart without a second pass."""
    def of(name: str, *columns: str) -> DataFrame:
        return report.where(F.col("part") == name).select(*columns)

    return {
        "partners": of("partners", "years", "country", "partner", "flow", "value", "unit"),
        "categories": of("categories", "years", "country", "partner", "category", "flow", "value", "unit"),
        "world_trade": of("world_trade", "year", "country", "partner", "category", "imports", "exports", "balance", "unit").orderBy(F.asc_nulls_last("year")),
    }
