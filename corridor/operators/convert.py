"""Conversion factor tables (T3, T4) and the factor join used by every query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CURRENCIES
from .joins import bounded, small, unique


def build_current_factors(fx: DataFrame, years: DataFrame, currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    """Units of each currency per USD by year, one row per year of the spine.

    ``fx``: (currency, year, per_usd). A year without a rate keeps its row
    with a null factor.
    """
    cur = list(currencies)
    wide = (
        unique(fx.select("currency", "year", "per_usd").where(F.col("currency").isin(cur)), ["currency", "year"], "exchange rates")
        .groupBy("year")
        .pivot("currency", cur)
        .agg(F.first("per_usd"))
    )
    return years.join(small(wide), "year", "left").select(
        "year", *[F.col(c).alias(f"{c}_current") for c in cur]
    )


def build_constant_factors(scaffold: DataFrame, deflators: DataFrame, fx: DataFrame, base_year: int,
                           currencies: Sequence[str] = CURRENCIES, min_non_null: int = 4) -> DataFrame:
    """Per-country constant-price factors.

    ``scaffold``: (year, country) rows to fill. ``deflators``: (country, year,
    deflator, lcu_per_usd). The factor turns current USD of country ``c`` in
    year ``y`` into base-year prices of a target currency:

        e(c,y) / (d(c,y) / d(c,B)) / e(c,B) * fx(cur,B)

    with ``e`` local currency per USD, ``d`` the GDP deflator and ``B`` the
    base year. Rows with fewer than ``min_non_null`` non-null fields
    (year, country and four factors) are dropped.
    """
    cur = list(currencies)
    deflators = unique(deflators.select("country", "year", "deflator", "lcu_per_usd"), ["country", "year"], "deflators")
    base = deflators.where(F.col("year") == base_year).select(
        "country", F.col("deflator").alias("d_base"), F.col("lcu_per_usd").alias("e_base")
    )
    local = (
        scaffold.join(small(deflators), ["country", "year"], "left")
        .join(small(base), "country", "left")
    )
    unit = (
        F.col("lcu_per_usd").cast("double")
        / (F.col("deflator").cast("double") / F.col("d_base").cast("double"))
        / F.col("e_base").cast("double")
    )

    def base_rate(c: str):
        # scalar subquery: the base-year rate of one currency, evaluated once
        return (
            fx.where((F.col("year") == base_year) & (F.col("currency") == c))
            .select(F.max(F.col("per_usd").cast("double")))
            .scalar()
        )

    return (
        local.select("year", "country", unit.alias("unit_factor"))
        .select("year", "country", *[(F.col("unit_factor") * base_rate(c)).alias(f"{c}_constant") for c in cur])
        .na.drop(thresh=min_non_null)
    )


def factor_frame(current: DataFrame, constant: DataFrame, factor_column: str, per_country: bool,
                 reporters: Sequence[str], broadcast: bool = True) -> tuple[DataFrame, list[str]]:
    """The factor dimension for one request and its join keys.

    Current prices: one factor per year. Constant prices and GDP shares: the
    reporter's own factor per (year, country), restricted to the reporter set.
    ``broadcast`` says the source table passed its size check; otherwise the
    join is left to the planner (shuffle join, re-planned by AQE).
    """
    hint = bounded if broadcast else (lambda d: d)
    if per_country:
        fac = constant.where(F.col("country").isin(list(reporters))).select(
            "year", F.col("country").alias("reporter"), F.col(factor_column).alias("factor")
        )
        return hint(fac), ["year", "reporter"]
    return hint(current.select("year", F.col(factor_column).alias("factor"))), ["year"]
