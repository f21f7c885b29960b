"""Multi-partner report: yearly series per partner group (Q4), partner x category matrix (Q5), both (Q7)."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ordered_mean, out, row_measures, share
from ..operators.joins import bounded
from ..params import Params
from .catalog import Catalog
from .core import converted, gdp_by_year, isin, sided, year_spine


def selected_groups(cat: Catalog, p: Params) -> list[str]:
    """Known partner names in request order, duplicates collapsed."""
    seen: list[str] = []
    for g in p.partners:
        if g in cat.groups and g not in seen:
            seen.append(g)
    return seen


def _rolled(cat: Catalog, p: Params, groups: list[str], category: str | None) -> DataFrame:
    """Converted bilateral flows per selected partner group (M2, L12): year, partner, category, e, i.

    A counterpart in k selected groups counts once in each of them. The
    membership rows of the (at most five) selected groups are broadcast and
    joined before any aggregate, so the caller's aggregate is the only shuffle.
    """
    reporters = cat.members(p.country)
    partners = cat.members(groups)
    view = sided(cat, p, reporters, ("exports", "imports"), counterparts=partners, category=category)
    roll = bounded(
        cat.membership.where(F.col("group_name").isin(groups)).select(
            F.col("country").alias("counterpart"), F.col("group_name").alias("partner"))
    )
    return converted(cat, p, view, reporters).join(roll, "counterpart", "inner").select(
        "year", "partner", "category",
        F.when(F.col("side") == "exports", F.col("amount")).alias("e"),
        F.when(F.col("side") == "imports", F.col("amount")).alias("i"),
    )


def _by_group(cat: Catalog, p: Params, groups: list[str], category: str | None, keys: list[str]) -> DataFrame:
    """Rolled-up exports and imports per ``keys`` (A9): one aggregate with a map-side partial."""
    return _rolled(cat, p, groups, category).groupBy(*keys).agg(
        F.sum("e").alias("exports"), F.sum("i").alias("imports"))


def partner_series(cat: Catalog, p: Params) -> DataFrame:
    """Q4: one row per (year, selected partner group) of the range, both flows.

    The (year, partner) scaffold enters the same aggregate as the flows, as
    rows without amounts, so every pair appears once and no join with the
    aggregated flows is needed.
    """
    groups = selected_groups(cat, p)
    reporters = cat.members(p.country)
    rows = _rolled(cat, p, groups, p.category).select("year", "partner", "e", "i")
    amount_type = rows.schema["e"].dataType
    scaffold = year_spine(cat, p.years).select(
        "year", F.explode(F.array(*[F.lit(g) for g in groups]).cast("array<string>")).alias("partner"),
        F.lit(None).cast(amount_type).alias("e"), F.lit(None).cast(amount_type).alias("i"))
    agg = rows.unionByName(scaffold).groupBy("year", "partner").agg(
        F.sum("e").alias("exports"), F.sum("i").alias("imports"))
    g = F.col("gdp") if p.is_gdp else None
    # yearly GDP is unique per year, so the left join only adds a column: skip it for money units
    joined = agg.join(gdp_by_year(cat, reporters), "year", "left") if p.is_gdp else agg
    return joined.select(
        F.col("year").cast("int").alias("year"), F.lit(p.country).alias("country"), "partner",
        F.lit(p.category).alias("category"), *row_measures(F.col("exports"), F.col("imports"), g),
        F.lit(p.unit_label).alias("unit"),
    ).orderBy("partner", "year")


def partner_matrix(cat: Catalog, p: Params) -> DataFrame:
    """Q5: partner group x category over the period, all categories.

    A missing flow counts as 0 (L10); years without a GDP row of the reporter
    set drop out (L9); GDP shares are averaged over the years present, money
    is summed (A12, L6, L13).
    """
    groups = selected_groups(cat, p)
    reporters = cat.members(p.country)
    if not p.is_gdp:
        # Money: the sum over years of yearly sums (missing = 0) is one sum over all rows, so a
        # single aggregate serves; years without a GDP row of the reporter set still drop out.
        gdp_years = cat.gdp.where(isin("country", reporters)).select("year").distinct()
        gdp_years = bounded(gdp_years) if "gdp" in cat.broadcastable else gdp_years
        tot = (_rolled(cat, p, groups, None).join(gdp_years, "year", "left_semi")
               .groupBy("partner", "category").agg(F.sum("e").alias("e"), F.sum("i").alias("i")))
        e, i = F.coalesce(F.col("e"), F.lit(0)), F.coalesce(F.col("i"), F.lit(0))
        res = tot.select("partner", "category", out(-i).alias("imports"), out(e).alias("exports"),
                         out(e - i).alias("balance"))
    else:
        # GDP shares are averaged over the years present, so the yearly rows are needed
        agg = _by_group(cat, p, groups, None, ["year", "partner", "category"])
        t = agg.join(gdp_by_year(cat, reporters), "year", "inner")
        e, i = share(F.col("exports"), F.col("gdp")), share(F.col("imports"), F.col("gdp"))
        rows = t.select(
            "year", "partner", "category",
            F.coalesce(-i, F.lit(0)).alias("imports"),
            F.coalesce(e, F.lit(0)).alias("exports"),
            (F.coalesce(e, F.lit(0)) - F.coalesce(i, F.lit(0))).alias("balance"),
        )
        res = rows.groupBy("partner", "category").agg(
            *[out(ordered_mean(F.col(c), F.col("year"))).alias(c) for c in ("imports", "exports", "balance")])
    return res.select(
        F.lit(p.years_label).alias("years"), F.lit(p.country).alias("country"), "partner", "category",
        "imports", "exports", "balance", F.lit(p.unit_label).alias("unit"),
    ).orderBy("partner", "category")


def multi_report(cat: Catalog, p: Params) -> dict[str, DataFrame]:
    """Q7: series and matrix over one persisted slice. No known partner -> both are empty.

    The slice (period, flows between the reporter set and the partners in
    either direction) is persisted (memory, then disk) and recomputable from
    its lineage; release it with ``single.unpersist_report``.
    """
    reporters = cat.members(p.country)
    partners = cat.members(selected_groups(cat, p))
    y0, y1 = p.years
    both = (isin("exporter", reporters) & isin("importer", partners)) | (
        isin("importer", reporters) & isin("exporter", partners))
    part = cat.flows.where(F.col("year").between(y0, y1)).where(both).persist(StorageLevel.MEMORY_AND_DISK)
    sub = replace(cat, flows=part)
    return {"plot": partner_series(sub, p), "table": partner_matrix(sub, p), "_slice": part}
