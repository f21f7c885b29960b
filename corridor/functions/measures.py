"""Measure arithmetic shared by every query: rounding, sign, share, null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import VALUE_TYPE


def to_money(total: Column, divisor: int = 1000, dtype: T.DecimalType = VALUE_TYPE) -> Column:
    """``total / divisor`` with banker's rounding to 2 dp, as a decimal.

    ``bround`` is HALF_EVEN; a plain cast would round half up. Exact for
    decimal input; for doubles it rounds the shortest decimal representation,
    like quantising ``str(float)``.
    """
    return F.bround(total / F.lit(divisor), 2).cast(dtype)


def out(c: Column) -> Column:
    """Final form of a reported measure: double, not rounded.

    Money is summed as DECIMAL and cast once; shares divide exact sums, and what
    is still added up as doubles is added in a fixed order (``ordered_mean``).
    """
    return c.cast("double")


def ordered_mean(value: Column, order: Column) -> Column:
    """Mean of a group's doubles added in the given order, so that it doesn't depend on task order.

    For groups bounded by the years of a report.
    """
    values = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size(values)


def signed(amount: Column, flow: str) -> Column:
    """Exports positive, imports negative (P10)."""
    return -amount if flow == "imports" else amount


def share(amount: Column, gdp: Column) -> Column:
    """Percent of GDP (P11); a zero or missing GDP gives null, never inf."""
    return amount.cast("double") / F.nullif(gdp.cast("double"), F.lit(0.0)) * F.lit(100.0)


def nz_sum(c: Column) -> Column:
    """``NULLIF(SUM(COALESCE(x, 0)), 0)``: missing counts as 0, a 0 total is "no trade" (P12)."""
    return F.nullif(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))


def zsum(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(0)))


def row_measures(exports: Column, imports: Column, gdp: Column | None = None) -> list[Column]:
    """imports (negative), exports, balance for one row per key.

    A zero or missing flow is null ("no trade"); the balance is null only when
    both are. ``exports``/``imports`` are positive magnitudes; with ``gdp``
    they become shares of it first.
    """
    if gdp is not None:
        exports, imports = share(exports, gdp), share(imports, gdp)
    imp = F.nullif(F.coalesce(-imports, F.lit(0)), F.lit(0))
    exp = F.nullif(F.coalesce(exports, F.lit(0)), F.lit(0))
    bal = F.when(imp.isNull() & exp.isNull(), F.lit(None)).otherwise(
        F.coalesce(exports, F.lit(0)) - F.coalesce(imports, F.lit(0)))
    return [out(imp).alias("imports"), out(exp).alias("exports"), out(bal).alias("balance")]
