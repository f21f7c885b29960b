"""Display values and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display wording that must agree with the reference product.
CURRENCY_PREFIX = {"usd": "US$", "eur": "€", "cad": "CA$", "gbp": "£"}
MONEY_SUFFIX_LONG = "Million"
MONEY_SUFFIX_SHORT = "M"
GDP_SUFFIX = "% of GDP"
SMALL_POSITIVE = "< 0.01"
SMALL_NEGATIVE = "> -0.01"
NUMBER_PATTERN = "#,##0.0#"   # thousands separators, one or two decimals


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded_value(c: Column | str) -> Column:
    """Value rounded to 2 places (half up, on the decimal digits); null -> 0."""
    c = _col(c)
    return F.coalesce(F.round(c.cast("decimal(38,6)"), 2).cast("double"), F.lit(0.0))


def value_label(c: Column | str) -> Column:
    """Display text of a value.

    null and 0 -> "0"; 0 < v < 0.01 -> "< 0.01"; -0.01 < v < 0 -> "> -0.01";
    else thousands separators with one or two decimals.
    """
    c = _col(c)
    r = F.round(c.cast("decimal(38,6)"), 2)
    return (
        F.when(c.isNull() | (c == 0), F.lit("0"))
        .when((c > 0) & (c < 0.01), F.lit(SMALL_POSITIVE))
        .when((c < 0) & (c > -0.01), F.lit(SMALL_NEGATIVE))
        .otherwise(F.call_function("format_number", r, F.lit(NUMBER_PATTERN)))
    )


def unit_text(unit: Column | str, long: bool = True, value: Column | None = None) -> Column:
    """Unit caption: "US$ Million", "€ M", " % of GDP"; with a value, "US$1,234.5 Million" (P20)."""
    unit = _col(unit)
    prefix = F.coalesce(
        F.element_at(F.create_map(*[x for kv in CURRENCY_PREFIX.items() for x in map(F.lit, kv)]), unit),
        F.lit(""),
    )
    suffix = F.when(unit == "gdp", F.lit(GDP_SUFFIX)).otherwise(
        F.lit(MONEY_SUFFIX_LONG if long else MONEY_SUFFIX_SHORT))
    prefix = F.when(unit == "gdp", F.lit("")).otherwise(prefix)
    if value is None:
        return F.concat(prefix, F.lit(" "), suffix)
    return F.concat(prefix, value, F.lit(" "), suffix)


def years_text(y0: int, y1: int) -> str:
    """Title/file form of a range: one year collapses."""
    return str(y0) if y0 == y1 else f"{y0}-{y1}"
