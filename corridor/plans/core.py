"""The slice every query starts from: filtered flows seen from the reporter set.

All five queries are group-bys over one shape,

    (year, side, reporter, counterpart, category, amount)

where ``side`` is exports (reporter = exporter) or imports (reporter =
importer) and ``amount`` is the value converted with the reporter's factor.
The fact is filtered with literal lists (pushed to the Parquet scan), the
factor dimension is broadcast, and the caller's aggregate runs map-side
first, so the only shuffle carries partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.convert import factor_frame
from ..operators.joins import bounded
from ..params import ALL_CATEGORIES, Params
from .catalog import Catalog


def isin(col: str, values: Sequence[str] | None) -> Column:
    return F.col(col).isin(list(values)) if values else F.lit(False)


def sided(cat: Catalog, p: Params, reporters: Sequence[str], sides: Sequence[str], *,
          counterparts: Sequence[str] | None = None, exclude_internal: bool = False,
          category: str | None = ALL_CATEGORIES) -> DataFrame:
    """Flow rows from the reporter set's point of view.

    exports: exporter in reporters; imports: importer in reporters.
    ``exclude_internal`` drops flows whose counterpart is also a reporter
    (F3); ``counterparts`` restricts the other side (F4, F6, F9). A row may
    appear once per side (a flow inside the reporter set, F5).
    """
    y0, y1 = p.years
    f = cat.flows.where(F.col("year").between(y0, y1))
    if category and category != ALL_CATEGORIES:
        f = f.where(F.col("category") == category)

    def side_cond(side: str) -> Column:
        me, other = ("exporter", "importer") if side == "exports" else ("importer", "exporter")
        c = isin(me, reporters)
        if exclude_internal:
            c = c & ~isin(other, reporters)
        if counterparts is not None:
            c = c & isin(other, counterparts)
        return c

    conds = {s: side_cond(s) for s in sides}
    keep = conds[sides[0]]
    for s in sides[1:]:
        keep = keep | conds[s]
    f = f.where(keep)

    def view(side: str) -> Column:
        me, other = ("exporter", "importer") if side == "exports" else ("importer", "exporter")
        return F.struct(F.lit(side).alias("side"), F.col(me).alias("reporter"), F.col(other).alias("counterpart"))

    if len(sides) == 1:
        s = sides[0]
        me, other = ("exporter", "importer") if s == "exports" else ("importer", "exporter")
        return f.select("year", F.lit(s).alias("side"), F.col(me).alias("reporter"),
                        F.col(other).alias("counterpart"), "category", "value")
    # one input row -> one row per side it qualifies for (no second scan); the
    # explode of a plain array stays inside whole-stage codegen
    rows = F.array(*[F.when(conds[s], view(s)) for s in sides])
    return (
        f.select("year", "category", "value", F.explode(rows).alias("v"))
        .where(F.col("v").isNotNull())
        .select("year", "v.side", "v.reporter", "v.counterpart", "category", "value")
    )


def converted(cat: Catalog, p: Params, view: DataFrame, reporters: Sequence[str]) -> DataFrame:
    """Attach the factor (inner join: no factor row, no trade) and the converted amount."""
    table = "constant" if p.per_country_factor else "current"
    fac, keys = factor_frame(cat.current, cat.constant, p.factor_column, p.per_country_factor, reporters,
                             broadcast=table in cat.broadcastable)
    return view.join(fac, keys, "inner").withColumn("amount", F.col("value") * F.col("factor"))


def gdp_by_year(cat: Catalog, reporters: Sequence[str]) -> DataFrame:
    """Yearly GDP of the reporter set: members with data are summed."""
    yearly = cat.gdp.where(isin("country", reporters)).groupBy("year").agg(F.sum("gdp_constant").alias("gdp"))
    return bounded(yearly) if "gdp" in cat.broadcastable else yearly


def gdp_total(cat: Catalog, reporters: Sequence[str], years: tuple[int, int]) -> Column:
    """Period GDP of the reporter set as a scalar subquery."""
    return (
        cat.gdp.where(isin("country", reporters) & F.col("year").between(*years))
        .select(F.sum("gdp_constant"))
        .scalar()
    )


def year_spine(cat: Catalog, years: tuple[int, int]) -> DataFrame:
    """Dense inclusive year range."""
    return cat.spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
