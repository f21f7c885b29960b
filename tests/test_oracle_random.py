"""Random parameters for Q1-Q5, each checked against the oracle on sf0.01."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corridor.checks import oracle
from corridor.checks.compare import compare, duck
from corridor.params import ALL_CATEGORIES, ALL_COUNTERPARTS, FLOWS, PRICES, UNITS, Params
from corridor.plans import multi, single

from .conftest import SF001

NAMES = [f"NATION_{i}" for i in range(22)] + ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "BLOC_A", "BLOC_B"]
CATS = [ALL_CATEGORIES] + [f"S{i:02d}" for i in range(1, 22)]


@st.composite
def requests(draw):
    y0 = draw(st.integers(1995, 2001))
    y1 = draw(st.integers(y0, 2001))
    return draw(st.sampled_from(["q1", "q2", "q3", "q3f", "q4", "q5"])), Params(
        draw(st.sampled_from(NAMES)), (y0, y1),
        unit=draw(st.sampled_from(UNITS)), prices=draw(st.sampled_from(PRICES)),
        category=draw(st.sampled_from(CATS)), flow=draw(st.sampled_from(FLOWS)),
        group=draw(st.sampled_from([ALL_COUNTERPARTS] + NAMES)),
        partners=tuple(draw(st.lists(st.sampled_from(NAMES), min_size=1, max_size=5, unique=True))),
    )


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@settings(max_examples=30, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(req=requests())
def test_random_requests_match_oracle(spark, sf001, con, req):
    kind, p = req
    groups = list(p.partners)
    spark_df, sql = {
        "q1": lambda: (single.top_partners(sf001, p), oracle.top_partners(p)),
        "q2": lambda: (single.top_categories(sf001, p), oracle.top_categories(p)),
        "q3": lambda: (single.world_trade(sf001, p), oracle.world_trade(p)),
        "q3f": lambda: (single.world_trade(sf001, p, fixed=True), oracle.world_trade(p, True)),
        "q4": lambda: (multi.partner_series(sf001, p), oracle.partner_series(p, groups)),
        "q5": lambda: (multi.partner_matrix(sf001, p), oracle.partner_matrix(p, groups)),
    }[kind]()
    res = compare(spark_df, sql, con)
    assert res["columns_match"] and res["types_match"], (kind, p, res)
    assert res["rows_spark"] == res["rows_oracle"] and res["match"], (kind, p, res)
