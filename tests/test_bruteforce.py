"""Q1/Q2 against a plain-Python brute force on the micro-fixture.

The brute force walks the fixture rows directly: period and category filter,
reporter side, internal-flow and counterpart rules, the factor lookup (no row:
no trade; null factor: no amount), the sum per key, the GDP share and the sign.
It shares nothing with the Spark plans but the parameter record.
"""

from __future__ import annotations

import itertools
from decimal import Decimal

import pytest

from tests.conftest import MICRO_CONSTANT, MICRO_CURRENT, MICRO_FLOWS, MICRO_GDP, MICRO_MEMBERSHIP
from corridor.params import ALL_CATEGORIES, ALL_COUNTERPARTS, PRICES, UNITS, Params
from corridor.plans import multi, single

Y = (2002, 2003)
NAMES = ("A", "B", "C", "G1", "G2")
CURRENCY_COLS = ("usd", "cad", "eur", "gbp")


def _members(name):
    m = sorted(c for g, c in MICRO_MEMBERSHIP if g == name)
    return m or [name]


def _factor(p: Params, year: int, reporter: str):
    """(found, factor): a missing row removes the trade, a null factor keeps the key."""
    col = "usd_constant" if p.is_gdp else f"{p.unit}_{p.prices}"
    cur, kind = col.split("_")
    i = CURRENCY_COLS.index(cur)
    if kind == "constant":
        rows = [r for r in MICRO_CONSTANT if r[0] == year and r[1] == reporter]
        return (True, rows[0][2 + i]) if rows else (False, None)
    rows = [r for r in MICRO_CURRENT if r[0] == year]
    return (True, rows[0][1 + i]) if rows else (False, None)


def _brute(p: Params, key: str, category_filter: bool) -> dict[str, float | None]:
    reporters = set(_members(p.country))
    counterparts = None if p.group == ALL_COUNTERPARTS else set(_members(p.group))
    totals: dict[str, Decimal | None] = {}
    for year, exporter, importer, category, value in MICRO_FLOWS:
        if not (p.years[0] <= year <= p.years[1]):
            continue
        if category_filter and p.category != ALL_CATEGORIES and category != p.category:
            continue
        me, other = (exporter, importer) if p.flow == "exports" else (importer, exporter)
        if me not in reporters or other in reporters:
            continue
        if counterparts is not None and other not in counterparts:
            continue
        found, factor = _factor(p, year, me)
        if not found:
            continue
        k = other if key == "partner" else category
        amount = None if factor is None else value * factor
        prev = totals.get(k)
        totals[k] = amount if prev is None else (prev if amount is None else prev + amount)
    gdp = [g for y, c, g in MICRO_GDP if c in reporters and p.years[0] <= y <= p.years[1] and g is not None]
    period_gdp = sum(gdp) if gdp else None
    out = {}
    for k, t in totals.items():
        if t is None:
            out[k] = None
            continue
        v = float(t)
        if p.is_gdp:
            v = None if not period_gdp else v / float(period_gdp) * 100.0
        out[k] = None if v is None else (-v if p.flow == "imports" else v)
    return out


def _spark(df, key: str) -> dict[str, float | None]:
    rows = df.collect()
    got = {r[key]: r["value"] for r in rows}
    assert len(got) == len(rows)  # one row per key
    return got


def _same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        if want[k] is None:
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(want[k], abs=1e-6), k


def _cases_units():
    for country, unit, prices, flow in itertools.product(NAMES, UNITS, PRICES, ("exports", "imports")):
        if unit == "gdp" and prices == "current":
            continue  # a GDP share always uses constant dollars: same query as gdp/constant
        yield Params(country, Y, unit=unit, prices=prices, flow=flow)


@pytest.mark.parametrize("country", NAMES)
def test_q1_every_unit_prices_flow(micro, country):
    for p in _cases_units():
        if p.country == country:
            _same(_spark(single.top_partners(micro, p), "partner"), _brute(p, "partner", True))


@pytest.mark.parametrize("country", NAMES)
def test_q2_every_unit_prices_flow(micro, country):
    for p in _cases_units():
        if p.country == country:
            _same(_spark(single.top_categories(micro, p), "category"), _brute(p, "category", False))


def test_q1_every_counterpart_group_and_category(micro):
    groups = (ALL_COUNTERPARTS,) + NAMES
    # every (reporter, counterpart group) pair in both flows; categories rotate over the pairs
    categories = itertools.cycle((ALL_CATEGORIES, "X", "Z"))
    for (country, group, flow), category in zip(
            itertools.product(NAMES, groups, ("exports", "imports")), categories):
        p = Params(country, Y, prices="constant", flow=flow, group=group, category=category)
        _same(_spark(single.top_partners(micro, p), "partner"), _brute(p, "partner", True))


def test_q1_single_years(micro):
    for country, year, unit in itertools.product(NAMES, (2002, 2003), ("usd", "gdp")):
        p = Params(country, (year, year), unit=unit, prices="constant")
        _same(_spark(single.top_partners(micro, p), "partner"), _brute(p, "partner", True))


def _brute_world(p: Params) -> list[tuple]:
    """Q3 in its published form: per-member exports full-outer-joined to per-member
    imports on (year, member), the export side's year kept, then summed by year
    over a dense year spine."""
    reporters = set(_members(p.country))
    sides: dict[str, dict[tuple, list]] = {"exports": {}, "imports": {}}
    for year, exporter, importer, category, value in MICRO_FLOWS:
        if not (p.years[0] <= year <= p.years[1]):
            continue
        if p.category != ALL_CATEGORIES and category != p.category:
            continue
        for side, me in (("exports", exporter), ("imports", importer)):
            if me not in reporters:
                continue
            found, factor = _factor(p, year, me)
            if found:
                sides[side].setdefault((year, me), []).append(None if factor is None else value * factor)

    def total(amounts):
        vals = [a for a in amounts if a is not None]
        return sum(vals) if vals else None

    exp, imp = sides["exports"], sides["imports"]
    joined = [(k[0], total(exp[k]), total(imp[k]) if k in imp else None) for k in exp]
    joined += [(None, None, total(imp[k])) for k in imp if k not in exp]
    joined += [(y, None, None) for y in range(p.years[0], p.years[1] + 1)]
    gdp: dict[int, float | None] = {}
    for y, c, g in MICRO_GDP:
        if c in reporters:
            gdp[y] = g if y not in gdp else (gdp[y] if g is None else (g if gdp[y] is None else gdp[y] + g))
    by_year: dict = {}
    for y, e, i in joined:
        e = None if e is None else float(e)
        i = None if i is None else float(i)
        if p.is_gdp:
            g = gdp.get(y)
            e = None if e is None or not g else e / g * 100.0
            i = None if i is None or not g else i / g * 100.0
        by_year.setdefault(y, []).append((e or 0.0, i or 0.0))
    out = []
    for y in sorted(by_year, key=lambda v: (v is None, v)):
        se, si = sum(e for e, _ in by_year[y]), sum(i for _, i in by_year[y])
        imports, exports = (-si or None), (se or None)
        balance = None if imports is None and exports is None else se - si
        out.append((y, imports, exports, balance))
    return out


def test_q3_published_form(micro):
    for country, (unit, prices), category in itertools.product(
            NAMES, (("usd", "current"), ("eur", "constant"), ("gdp", "constant"), ("cad", "current")),
            (ALL_CATEGORIES, "X")):
        p = Params(country, Y, unit=unit, prices=prices, category=category)
        got = [(r.year, r.imports, r.exports, r.balance) for r in single.world_trade(micro, p).collect()]
        want = _brute_world(p)
        assert [g[0] for g in got] == [w[0] for w in want], p
        for g, w in zip(got, want):
            for a, b in zip(g[1:], w[1:]):
                assert (a is None and b is None) or a == pytest.approx(b, abs=1e-6), (p, g, w)


def _brute_series(p: Params) -> list[tuple]:
    """Q4: per (partner group, year) of the range, both flows; a counterpart in
    several selected groups counts in each; unknown names are dropped."""
    known = {g for g, _ in MICRO_MEMBERSHIP}
    groups = list(dict.fromkeys(g for g in p.partners if g in known))
    reporters = set(_members(p.country))
    sums = {(g, y): [None, None] for g in groups for y in range(p.years[0], p.years[1] + 1)}
    for year, exporter, importer, category, value in MICRO_FLOWS:
        if not (p.years[0] <= year <= p.years[1]):
            continue
        if p.category != ALL_CATEGORIES and category != p.category:
            continue
        for idx, me, other in ((0, exporter, importer), (1, importer, exporter)):
            if me not in reporters:
                continue
            found, factor = _factor(p, year, me)
            if not found:
                continue
            for g in groups:
                if other in _members(g):
                    cell = sums[(g, year)]
                    if factor is not None:
                        cell[idx] = value * factor if cell[idx] is None else cell[idx] + value * factor
    gdp: dict[int, float | None] = {}
    for y, c, g in MICRO_GDP:
        if c in reporters:
            gdp[y] = g if y not in gdp else (gdp[y] if g is None else (g if gdp[y] is None else gdp[y] + g))
    out = []
    for (g, y), (e, i) in sorted(sums.items()):
        e = None if e is None else float(e)
        i = None if i is None else float(i)
        if p.is_gdp:
            d = gdp.get(y)
            e = None if e is None or not d else e / d * 100.0
            i = None if i is None or not d else i / d * 100.0
        imports, exports = (-(i or 0.0) or None), ((e or 0.0) or None)
        balance = None if imports is None and exports is None else (e or 0.0) - (i or 0.0)
        out.append((g, y, imports, exports, balance))
    return out


def test_q4_partner_series(micro):
    partner_lists = (("G2", "C"), ("A", "B", "C"), ("G1", "nowhere", "G1", "G2"))
    for country, partners, (unit, prices) in itertools.product(
            NAMES, partner_lists, (("usd", "current"), ("gdp", "constant"), ("eur", "constant"))):
        p = Params(country, Y, unit=unit, prices=prices, partners=partners)
        got = [(r.partner, r.year, r.imports, r.exports, r.balance)
               for r in multi.partner_series(micro, p).collect()]
        want = _brute_series(p)
        assert [g[:2] for g in got] == [w[:2] for w in want], p
        for g, w in zip(got, want):
            for a, b in zip(g[2:], w[2:]):
                assert (a is None and b is None) or a == pytest.approx(b, abs=1e-6), (p, g, w)


def _brute_matrix(p: Params) -> list[tuple]:
    """Q5: partner group x category over the years with a GDP row of the reporter
    set; money is summed, GDP shares averaged over the yearly cells present."""
    known = {g for g, _ in MICRO_MEMBERSHIP}
    groups = list(dict.fromkeys(g for g in p.partners if g in known))
    reporters = set(_members(p.country))
    gdp_rows = [(y, g) for y, c, g in MICRO_GDP if c in reporters]
    gdp = {y: (sum(g for yy, g in gdp_rows if yy == y and g is not None)
               if any(yy == y and g is not None for yy, g in gdp_rows) else None) for y, _ in gdp_rows}
    cells: dict[tuple, list] = {}
    for year, exporter, importer, category, value in MICRO_FLOWS:
        if not (p.years[0] <= year <= p.years[1]) or year not in gdp:
            continue
        for idx, me, other in ((0, exporter, importer), (1, importer, exporter)):
            if me not in reporters:
                continue
            found, factor = _factor(p, year, me)
            if not found:
                continue
            for g in groups:
                if other in _members(g):
                    cell = cells.setdefault((g, category, year), [None, None])
                    if factor is not None:
                        cell[idx] = value * factor if cell[idx] is None else cell[idx] + value * factor
    per: dict[tuple, list] = {}
    for (g, category, year), (e, i) in cells.items():
        e = None if e is None else float(e)
        i = None if i is None else float(i)
        if p.is_gdp:
            d = gdp[year]
            e = None if e is None or not d else e / d * 100.0
            i = None if i is None or not d else i / d * 100.0
        per.setdefault((g, category), []).append((e or 0.0, i or 0.0))
    out = []
    for key, vals in sorted(per.items()):
        se, si = sum(e for e, _ in vals), sum(i for _, i in vals)
        n = len(vals) if p.is_gdp else 1
        out.append((*key, -si / n, se / n, (se - si) / n))
    return out


def test_q5_partner_matrix(micro):
    partner_lists = (("G2", "C"), ("A", "B", "C"), ("G1", "nowhere", "G1", "G2"))
    for country, partners, (unit, prices) in itertools.product(
            NAMES, partner_lists, (("usd", "current"), ("gdp", "constant"))):
        p = Params(country, Y, unit=unit, prices=prices, partners=partners)
        got = [(r.partner, r.category, r.imports, r.exports, r.balance)
               for r in multi.partner_matrix(micro, p).collect()]
        want = _brute_matrix(p)
        assert [g[:2] for g in got] == [w[:2] for w in want], p
        for g, w in zip(got, want):
            for a, b in zip(g[2:], w[2:]):
                assert a == pytest.approx(b, abs=1e-6), (p, g, w)


def _rows_match(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        for a, b in zip(g[2:], w[2:]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-6), (g, w)


@pytest.mark.parametrize("unit,prices", [("gdp", "constant"), ("cad", "current")])
def test_bundles_over_the_shared_slice(micro, unit, prices):
    # Q6/Q7 read one persisted slice; every part must equal the brute force on the full rows
    for country in NAMES:
        p = Params(country, Y, unit=unit, prices=prices, flow="imports", partners=("G2", "C", "A"))
        rep = single.single_report(micro, p)
        try:
            _same(_spark(rep["partners"], "partner"), _brute(p, "partner", True))
            _same(_spark(rep["categories"], "category"), _brute(p, "category", False))
            world = [(r.year, r.imports, r.exports, r.balance) for r in rep["world_trade"].collect()]
            want = _brute_world(p)
            assert [w[0] for w in world] == [w[0] for w in want]
            _rows_match([(0,) + w for w in world], [(0,) + w for w in want])
        finally:
            single.unpersist_report(rep)
        rep = multi.multi_report(micro, p)
        try:
            _rows_match([(r.partner, r.year, r.imports, r.exports, r.balance) for r in rep["plot"].collect()],
                        _brute_series(p))
            _rows_match([(r.partner, r.category, r.imports, r.exports, r.balance) for r in rep["table"].collect()],
                        _brute_matrix(p))
        finally:
            single.unpersist_report(rep)
