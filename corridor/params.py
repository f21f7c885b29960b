"""Query parameters: one validated, immutable record per request."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Fixed values that must agree with the reference product.
ALL_COUNTERPARTS = "All countries*"   # sentinel: no counterpart restriction
ALL_CATEGORIES = "All"                # sentinel: every product section
REST_OF_WORLD = "RoW"                 # partner label of the aggregate queries
UNITS = ("usd", "cad", "eur", "gbp", "gdp")
PRICES = ("constant", "current")
FLOWS = ("exports", "imports")
MAX_PARTNERS = 5
GDP_UNIT_LABEL = "share of gdp"
MONEY_UNIT_LABEL = "{prices} {unit} million"


@dataclass(frozen=True)
class Params:
    """Everything a query needs besides the tables.

    ``country`` and ``group``/``partners`` are names from the membership
    dimension: a country is its own single-member group.
    """

    country: str
    years: tuple[int, int]
    unit: str = "usd"
    prices: str = "current"
    category: str = ALL_CATEGORIES
    flow: str = "exports"
    group: str = ALL_COUNTERPARTS
    partners: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, got {self.unit!r}")
        if self.prices not in PRICES:
            raise ValueError(f"prices must be one of {PRICES}, got {self.prices!r}")
        if self.flow not in FLOWS:
            raise ValueError(f"flow must be one of {FLOWS}, got {self.flow!r}")
        y0, y1 = self.years
        if y0 > y1:
            object.__setattr__(self, "years", (y1, y0))
        object.__setattr__(self, "partners", tuple(self.partners))

    # -- derived, all decided on the driver ---------------------------------
    @property
    def is_gdp(self) -> bool:
        return self.unit == "gdp"

    @property
    def factor_column(self) -> str:
        """Conversion column; a GDP share is taken of constant US dollars."""
        return "usd_constant" if self.is_gdp else f"{self.unit}_{self.prices}"

    @property
    def per_country_factor(self) -> bool:
        """Constant prices (and GDP shares) convert with the reporter's factor."""
        return self.is_gdp or self.prices == "constant"

    @property
    def unit_label(self) -> str:
        return GDP_UNIT_LABEL if self.is_gdp else MONEY_UNIT_LABEL.format(prices=self.prices, unit=self.unit)

    @property
    def years_label(self) -> str:
        return f"{self.years[0]}-{self.years[1]}"

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def sanitize_years(y0, y1, bounds: tuple[int, int]) -> tuple[int, int]:
    """Range input rule: NaN -> bound, clamp into bounds, order the pair."""
    lo, hi = bounds

    def fix(v, default):
        try:
            v = float(v)
        except (TypeError, ValueError):
            return default
        if math.isnan(v):
            return default
        return int(min(max(v, lo), hi))

    a, b = fix(y0, lo), fix(y1, hi)
    return (min(a, b), max(a, b))


def select_partners(names, known) -> tuple[str, ...]:
    """Partner choice rule: known names only, duplicates collapse; more than the published five raise."""
    known = set(known)
    out = list(dict.fromkeys(n for n in names if n in known))
    if len(out) > MAX_PARTNERS:
        raise ValueError(f"at most {MAX_PARTNERS} partners, got {len(out)}")
    return tuple(out)
