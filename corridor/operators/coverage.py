"""GDP table (T5) and coverage shares (T6) from a long macro-indicator table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import small

GDP_CODE, GDP_UNIT, POP_CODE, WORLD = "NGDPD", "U.S. dollars", "LP", "World"  # fixed indicator keys


def _norm(c):
    return F.lower(F.trim(c))


def resolve_names(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    """Attach ``iso3`` by a case- and space-insensitive alias lookup; unmatched -> null.

    An alias with several codes raises: it would repeat rows.
    """
    one = F.when(F.count_distinct("iso3") > 1, F.raise_error(F.concat(F.lit("several iso3 codes for alias "), F.first("_alias"))))
    al = small(aliases.select(_norm(F.col("alias")).alias("_alias"), "iso3").groupBy("_alias")
               .agg(F.coalesce(one.cast("string"), F.min("iso3")).alias("iso3")))
    return df.withColumn("_alias", _norm(F.col(name_col))).join(al, "_alias", "left").drop("_alias")


def name_resolution_audit(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    """(name, iso3, n_rows, matched) of every distinct name: what the alias table resolves and what it doesn't."""
    names = df.groupBy(F.col(name_col).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return resolve_names(names, "name", aliases).select("name", "iso3", "n_rows", F.col("iso3").isNotNull().alias("matched"))


def build_gdp(scaffold: DataFrame, indicators: DataFrame, aliases: DataFrame, deflators: DataFrame,
              base_country: str, base_year: int) -> DataFrame:
    """(year, country, gdp_constant): GDP in million base-year USD for every scaffold row.

    Current GDP (billion USD) is matched on (ISO3, year) with a left join, so
    a missing value leaves the row with a null; it is then deflated with the
    base country's deflator rebased to its base year.
    """
    gdp = resolve_names(
        indicators.where((F.col("indicator_code") == GDP_CODE) & (F.col("unit") == GDP_UNIT))
        .select("year", "entity_name", (F.col("value") * F.lit(1000.0)).alias("gdp_current")),
        "entity_name", aliases,
    ).where(F.col("iso3").isNotNull()).drop("entity_name")
    dupes = gdp.groupBy("iso3", "year").count().where(F.col("count") > 1)
    if dupes.limit(1).count():  # a left join would fan the scaffold out
        raise ValueError(f"GDP values not unique per (iso3, year), e.g. {dupes.first().asDict()}")
    base = deflators.where(F.col("country") == base_country)
    d_base = base.where(F.col("year") == base_year).select(F.max("deflator")).scalar()
    rebased = small(base.select("year", (F.col("deflator") / d_base).alias("d")))
    merged = resolve_names(scaffold, "country", aliases).join(small(gdp), ["iso3", "year"], "left")
    return merged.join(rebased, "year", "left").select(
        "year", "country", (F.col("gdp_current") / F.col("d")).alias("gdp_constant")
    )


def build_coverage(countries: DataFrame, indicators: DataFrame, aliases: DataFrame, year: int) -> DataFrame:
    """One row: n_countries, gdp_share, pop_share of the covered sample in ``year``.

    GDP share divides by the ``World`` row; population share by the sum of
    every population row. One conditional-aggregation pass over the year.
    """
    sample = resolve_names(countries.select("country"), "country", aliases)
    codes = small(sample.where(F.col("iso3").isNotNull()).select("iso3").distinct()
                    .withColumn("in_sample", F.lit(True)))
    ind = resolve_names(indicators.where(F.col("year") == year), "entity_name", aliases).join(codes, "iso3", "left")
    is_gdp = (F.col("indicator_code") == GDP_CODE) & (F.col("unit") == GDP_UNIT)
    is_pop = F.col("indicator_code") == POP_CODE
    inside = F.col("in_sample").isNotNull()
    n = countries.select(F.count("country")).scalar()
    return ind.agg(
        F.sum(F.when(is_gdp & inside, F.col("value"))).alias("g_sample"),
        F.sum(F.when(is_gdp & (F.col("entity_name") == WORLD), F.col("value"))).alias("g_world"),
        F.sum(F.when(is_pop & inside, F.col("value"))).alias("p_sample"),
        F.sum(F.when(is_pop, F.col("value"))).alias("p_world"),
    ).select(
        n.cast("int").alias("n_countries"),
        (F.col("g_sample") / F.col("g_world") * F.lit(100.0)).alias("gdp_share"),
        (F.col("p_sample") / F.col("p_world") * F.lit(100.0)).alias("pop_share"),
    )


def coverage_display(cov: DataFrame) -> DataFrame:
    """Shares as shown: one decimal place."""
    return cov.select("n_countries", F.round("gdp_share", 1).alias("gdp_share"), F.round("pop_share", 1).alias("pop_share"))


def sample_note(cov: DataFrame, membership: DataFrame, reporter: str) -> DataFrame:
    """Counterparts of a reporter within the sample, with the shares as shown.

    The sample has ``n_countries`` members; a reporter group's own members are
    not its partners. The group size is a scalar subquery.
    """
    size = membership.where(F.col("group_name") == reporter).select(F.count("country")).scalar()
    return coverage_display(cov).select(
        F.lit(reporter).alias("country"), (F.col("n_countries") - size).cast("int").alias("n_partners"),
        "gdp_share", "pop_share")
