"""Single-country report: top partners (Q1), top categories (Q2), world trade (Q3), all three (Q6)."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import nz_sum, out, row_measures, share, signed, zsum
from ..params import ALL_COUNTERPARTS, REST_OF_WORLD, Params
from .catalog import Catalog
from .core import converted, gdp_by_year, gdp_total, isin, sided, year_spine


def _labels(p: Params) -> list[Column]:
    return [F.lit(p.years_label).alias("years"), F.lit(p.country).alias("country")]


def _one_side(cat: Catalog, p: Params, category: str | None) -> tuple[DataFrame, tuple[str, ...]]:
    reporters = cat.members(p.country)
    counterparts = None if p.group == ALL_COUNTERPARTS else cat.members(p.group)
    view = sided(cat, p, reporters, (p.flow,), counterparts=counterparts, exclude_internal=True, category=category)
    return converted(cat, p, view, reporters), reporters


def _value(cat: Catalog, p: Params, total: Column, reporters) -> Column:
    v = share(total, gdp_total(cat, reporters, p.years)) if p.is_gdp else total
    return out(signed(v, p.flow)).alias("value")


def top_partners(cat: Catalog, p: Params) -> DataFrame:
    """Q1: the reporter set's trade by counterpart over the period, one flow.

    Flows inside the reporter set are excluded (L1); a counterpart group
    restricts the other side (F4). GDP shares divide by the period GDP (L6).
    """
    amt, reporters = _one_side(cat, p, p.category)
    agg = amt.groupBy(F.col("counterpart").alias("partner")).agg(F.sum("amount").alias("total"))
    return agg.select(*_labels(p), "partner", F.lit(p.flow).alias("flow"),
                      _value(cat, p, F.col("total"), reporters), F.lit(p.unit_label).alias("unit"))


def top_categories(cat: Catalog, p: Params) -> DataFrame:
    """Q2: as Q1 by product category, always over all categories."""
    amt, reporters = _one_side(cat, p, None)
    agg = amt.groupBy("category").agg(F.sum("amount").alias("total"))
    return agg.select(*_labels(p), F.lit(REST_OF_WORLD).alias("partner"), "category",
                      F.lit(p.flow).alias("flow"), _value(cat, p, F.col("total"), reporters),
                      F.lit(p.unit_label).alias("unit"))


def _measures(exports: Column, imports: Column, gdp: Column | None) -> list[Column]:
    """imports (negative), exports, balance from positive magnitudes, aggregated.

    The rows of a group share one GDP, so exact sums are divided instead of shares summed.
    """
    if gdp is not None:
        return row_measures(F.sum(exports), F.sum(imports), F.max(gdp))
    imp, exp = nz_sum(-imports), nz_sum(exports)
    bal = F.when(imp.isNull() & exp.isNull(), F.lit(None)).otherwise(zsum(exports) - zsum(imports))
    return [out(imp).alias("imports"), out(exp).alias("exports"), out(bal).alias("balance")]


def world_trade(cat: Catalog, p: Params, fixed: bool = False) -> DataFrame:
    """Q3: the reporter set's yearly exports, imports and balance with everyone.

    Flows inside a reporter group count on both sides (L1). The default
    reproduces the published join exactly: exports per member are matched to
    imports per member by (year, country), so a member that imports in a year
    without exporting lands in a row with a null year (L4, L5).
    ``fixed=True`` stacks both sides per year instead and has no such row.
    """
    reporters = cat.members(p.country)
    view = sided(cat, p, reporters, ("exports", "imports"), category=p.category)
    amounts = converted(cat, p, view, reporters)
    is_exp, is_imp = F.col("side") == "exports", F.col("side") == "imports"
    spine = year_spine(cat, p.years)
    gdp = gdp_by_year(cat, reporters).select(F.col("year").alias("g_year"), "gdp")
    g = F.col("gdp") if p.is_gdp else None
    if fixed:
        # yearly totals straight from the flows; the spine keeps years without any
        yearly = amounts.groupBy("year").agg(
            F.sum(F.when(is_exp, F.col("amount"))).alias("exports"),
            F.sum(F.when(is_imp, F.col("amount"))).alias("imports"))
        joined = spine.join(yearly, "year", "left")
        if p.is_gdp:  # unique per year: the left join only adds the GDP column
            joined = joined.join(gdp, F.col("year") == F.col("g_year"), "left")
        res = joined.select("year", *row_measures(F.col("exports"), F.col("imports"), g))  # one row per year
    else:
        # The published form joins exports per member to imports per member on
        # (year, country) and keeps unmatched rows of both. Per member-year that
        # is: keyed by its year when the member exported, else by a null year;
        # exports only when exported, imports only when imported. Every spine
        # year adds one all-null row, which keeps years without exporters and
        # adds nothing to the sums of the others. No join, no self-join. Both
        # sides come from one aggregate over one scan; the counts say whether a
        # side exists at all for a member-year (its sum may still be null).
        per = amounts.groupBy("year", "reporter").agg(
            F.sum(F.when(is_exp, F.col("amount"))).alias("exports"),
            F.count(F.when(is_exp, F.lit(1))).alias("n_exp"),
            F.sum(F.when(is_imp, F.col("amount"))).alias("imports"),
            F.count(F.when(is_imp, F.lit(1))).alias("n_imp"),
        )
        exported = F.col("n_exp") > 0
        rows = per.select(
            F.when(exported, F.col("year")).alias("year"),
            F.when(exported, F.col("exports")).alias("exports"),
            F.when(F.col("n_imp") > 0, F.col("imports")).alias("imports"),
        )
        empty = spine.select("year", *[F.lit(None).cast(rows.schema[c].dataType).alias(c)
                                       for c in ("exports", "imports")])
        joined = rows.unionByName(empty)
        if p.is_gdp:  # unique per year: the left join only adds the GDP column
            joined = joined.join(gdp, F.col("year") == F.col("g_year"), "left")
        res = joined.groupBy("year").agg(*_measures(F.col("exports"), F.col("imports"), g))
    return res.select(
        F.col("year").cast("int").alias("year"), F.lit(p.country).alias("country"),
        F.lit(REST_OF_WORLD).alias("partner"), F.lit(p.category).alias("category"),
        "imports", "exports", "balance", F.lit(p.unit_label).alias("unit"),
    ).orderBy(F.asc_nulls_last("year"))


def single_report(cat: Catalog, p: Params) -> dict[str, DataFrame]:
    """Q6: partners, categories and world trade over one persisted slice.

    The slice (period, reporter set on either side) is the common input of all
    three; it is persisted (memory, then disk) and recomputable from its
    lineage if an executor is lost. Call ``unpersist_report`` when done.
    """
    reporters = cat.members(p.country)
    y0, y1 = p.years
    part = (
        cat.flows.where(F.col("year").between(y0, y1))
        .where(isin("exporter", reporters) | isin("importer", reporters))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    sub = replace(cat, flows=part)
    return {
        "partners": top_partners(sub, p),
        "categories": top_categories(sub, p),
        "world_trade": world_trade(sub, p),
        "_slice": part,
    }


def unpersist_report(report: dict[str, DataFrame]) -> None:
    s = report.get("_slice")
    if s is not None:
        s.unpersist()


__all__ = ["top_partners", "top_categories", "world_trade", "single_report", "unpersist_report"]
