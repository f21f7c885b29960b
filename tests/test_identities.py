"""Identities between the queries on sf0.01."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corridor.params import Params
from corridor.plans import multi, single

YEARS = (1995, 2001)
rng = random.Random(7)
NATIONS = [f"NATION_{i}" for i in range(22)]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def total(df, col="value"):
    return df.agg(F.sum(col)).first()[0] or 0.0


def cases(n):
    out = []
    for _ in range(n):
        y0 = rng.randint(1995, 2000)
        out.append((rng.choice(NATIONS + REGIONS), (y0, rng.randint(y0, 2001)), rng.choice(["usd", "eur", "gbp"]),
                    rng.choice(["current", "constant"]), rng.choice(["exports", "imports"])))
    return out


@pytest.mark.parametrize("country,years,unit,prices,flow", cases(4))
def test_partners_and_categories_agree(sf001, country, years, unit, prices, flow):
    p = Params(country, years, unit=unit, prices=prices, flow=flow)
    assert total(single.top_partners(sf001, p)) == pytest.approx(total(single.top_categories(sf001, p)), abs=1e-4)


@pytest.mark.parametrize("country", ["NATION_3", "NATION_12", "NATION_21"])
def test_world_trade_equals_partner_totals_for_one_country(sf001, country):
    p = Params(country, YEARS, unit="usd")
    wt = single.world_trade(sf001, p, fixed=True)
    # world trade counts a country's trade with itself, partner tables leave it out (L1)
    own = float(sf001.flows.where((F.col("exporter") == country) & (F.col("importer") == country)).agg(F.sum("value")).first()[0])
    assert total(wt, "exports") == pytest.approx(total(single.top_partners(sf001, p)) + own, abs=1e-4)
    assert total(wt, "imports") == pytest.approx(total(single.top_partners(sf001, p.with_(flow="imports"))) - own, abs=1e-4)


@pytest.mark.parametrize("group", ["EUROPE", "BLOC_A"])
def test_group_world_trade_minus_partners_is_internal_trade(sf001, group):
    p = Params(group, YEARS, unit="usd")
    members = sf001.members(group)
    internal = (sf001.flows.where(F.col("exporter").isin(list(members)) & F.col("importer").isin(list(members)))
                .agg(F.sum("value")).first()[0])
    gap = total(single.world_trade(sf001, p), "exports") - total(single.top_partners(sf001, p))
    assert gap == pytest.approx(float(internal), abs=1e-4)


def test_series_balance_is_exports_plus_imports(sf001):
    df = multi.partner_series(sf001, Params("NATION_8", YEARS, unit="eur", prices="constant",
                                            partners=("BLOC_A", "AFRICA", "NATION_2")))
    for r in df.where("imports IS NOT NULL AND exports IS NOT NULL").collect():
        assert r.balance == pytest.approx(r.exports + r.imports, abs=1e-5)


@pytest.mark.parametrize("country,partners", [("NATION_1", ("EUROPE", "NATION_2")), ("AFRICA", ("BLOC_B",))])
def test_matrix_sums_to_series(sf001, country, partners):
    p = Params(country, YEARS, unit="usd", partners=partners)
    m = {r.partner: r[1] for r in multi.partner_matrix(sf001, p).groupBy("partner").agg(F.sum("exports")).collect()}
    s = {r.partner: r[1] for r in multi.partner_series(sf001, p).groupBy("partner").agg(F.sum("exports")).collect()}
    assert m.keys() == s.keys()
    for k in m:
        assert m[k] == pytest.approx(s[k], abs=1e-4)


@pytest.mark.parametrize("a,b", [("NATION_1", "NATION_2"), ("NATION_8", "NATION_13")])
def test_current_prices_mirror(sf001, a, b):
    # In current prices A's exports to B are B's imports from A
    ab = {r.year: r.exports for r in multi.partner_series(sf001, Params(a, YEARS, partners=(b,))).collect()}
    ba = {r.year: r.imports for r in multi.partner_series(sf001, Params(b, YEARS, partners=(a,))).collect()}
    for y in ab:
        assert (ab[y] is None and ba[y] is None) or ab[y] == pytest.approx(-ba[y], abs=1e-6)


def test_round_trip_and_flow_count(sf001):
    from corridor.operators import normalize

    back = normalize.to_long(normalize.to_wide(sf001.flows, sf001.categories))
    assert back.count() == sf001.flows.count() == 27498
