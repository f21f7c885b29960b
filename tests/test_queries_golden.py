"""Q1-Q5 on the golden micro-fixture, values worked out by hand."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal as D

import pytest

from corridor.params import Params
from corridor.plans import multi, single

Y = (2002, 2003)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))


def test_q1_current_exports(micro):
    df = single.top_partners(micro, Params("A", Y))
    assert df.columns == ["years", "country", "partner", "flow", "value", "unit"]
    assert rows(df, "partner", "value") == [("B", 27.0), ("C", 26.0)]
    r = df.first()
    assert (r.years, r.country, r.flow, r.unit) == ("2002-2003", "A", "exports", "current usd million")


def test_q1_group_reporter_drops_internal_flows(micro):
    # L1: A->B and B->A are inside G1 and do not count
    assert rows(single.top_partners(micro, Params("G1", Y)), "partner", "value") == [("C", 33.0)]


def test_q1_imports_are_negative_and_use_the_year_factor(micro):
    df = single.top_partners(micro, Params("G1", Y, unit="eur", flow="imports"))
    assert rows(df, "partner", "value") == [("C", -9.2)]


def test_q1_constant_uses_reporter_factor(micro):
    assert rows(single.top_partners(micro, Params("A", Y, prices="constant")), "partner", "value") == [
        ("B", 54.0), ("C", 52.0)]


def test_q1_null_factor_is_ignored(micro):
    # L3: C's 2002 factor is null, so only its 2003 trade counts
    df = single.top_partners(micro, Params("C", Y, prices="constant"))
    assert rows(df, "partner", "value") == [("A", 8.0), ("B", 1.0)]


def test_q1_missing_factor_row_removes_trade(micro):
    # L2: B has no constant factor in 2003; its 2003 imports vanish
    df = single.top_partners(micro, Params("B", Y, prices="constant", flow="imports"))
    assert rows(df, "partner", "value") == [("A", -22.5), ("C", 0.0)]


def test_q1_gdp_divides_by_period_gdp(micro):
    # Constant USD over summed GDP of the period
    df = single.top_partners(micro, Params("A", Y, unit="gdp", prices="current"))
    assert rows(df, "partner", "value") == [("B", 18.0), ("C", 52 / 300 * 100)]  # not rounded
    assert df.first().unit == "share of gdp"


def test_q1_group_gdp_skips_null_members(micro):
    # GDP of G1 = 100 + 200 + 50 (B's null skipped)
    assert rows(single.top_partners(micro, Params("G1", Y, unit="gdp")), "partner", "value") == [
        ("C", pytest.approx(62.5 / 350 * 100, rel=1e-15))]


def test_q1_counterpart_group(micro):
    assert rows(single.top_partners(micro, Params("A", Y, group="C")), "partner", "value") == [("C", 26.0)]
    assert rows(single.top_partners(micro, Params("A", Y, group="G1")), "partner", "value") == [("B", 27.0)]


def test_q1_counterpart_inside_reporter_is_empty(micro):
    # L17
    assert single.top_partners(micro, Params("G1", Y, group="A")).count() == 0


def test_q1_single_category(micro):
    assert rows(single.top_partners(micro, Params("A", Y, category="Y")), "partner", "value") == [
        ("B", 5.0), ("C", 6.0)]


def test_q2_by_category(micro):
    df = single.top_categories(micro, Params("A", Y, category="Y"))  # category ignored: always all
    assert rows(df, "category", "value") == [("X", 42.0), ("Y", 11.0)]
    assert {r.partner for r in df.collect()} == {"RoW"}


def test_q3_null_year_row(micro):
    # L4: B imports in 2003 but exports nothing -> its imports land in a null-year row
    df = single.world_trade(micro, Params("B", Y))
    got = [(r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [(2002, -15.0, 10.0, -5.0), (2003, None, None, None), (None, -13.0, None, -13.0)]


def test_q3_fixed_has_no_null_year(micro):
    df = single.world_trade(micro, Params("B", Y), fixed=True)
    got = [(r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [(2002, -15.0, 10.0, -5.0), (2003, -13.0, None, -13.0)]


def test_q3_group_keeps_internal_flows(micro):
    df = single.world_trade(micro, Params("G1", Y))
    got = [(r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [(2002, -22.0, 45.0, 23.0), (2003, -8.0, 18.0, 10.0), (None, -13.0, None, -13.0)]


def test_q3_gdp_per_year(micro):
    df = single.world_trade(micro, Params("A", Y, unit="gdp"))
    got = [(r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [pytest.approx(x, rel=1e-12) for x in ((2002, -14.0, 70.0, 56.0), (2003, -8.0, 18.0, 10.0))]


def test_q4_overlapping_partner_groups(micro):
    # C counts in G2 and in itself
    df = multi.partner_series(micro, Params("A", Y, partners=("G2", "C")))
    got = [(r.partner, r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [("C", 2002, -4.0, 20.0, 16.0), ("C", 2003, -8.0, 6.0, -2.0),
                   ("G2", 2002, -7.0, 35.0, 28.0), ("G2", 2003, -8.0, 18.0, 10.0)]


def test_q4_missing_flow_is_null(micro):
    # In the series a missing flow is null, balance only when both are
    df = multi.partner_series(micro, Params("B", Y, category="Z", partners=("C",)))
    got = [(r.year, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [(2002, None, 7.0, 7.0), (2003, -1.0, None, -1.0)]


def test_q4_unknown_or_no_partner_is_empty(micro):
    assert multi.partner_series(micro, Params("A", Y, partners=())).count() == 0
    assert multi.partner_matrix(micro, Params("A", Y, partners=("nowhere",))).count() == 0


def test_q5_sums_money(micro):
    df = multi.partner_matrix(micro, Params("A", Y, partners=("G2",)))
    got = [(r.partner, r.category, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [("G2", "X", -11.0, 42.0, 31.0), ("G2", "Y", -4.0, 11.0, 7.0)]
    assert df.first().years == "2002-2003"


def test_q5_gdp_averages_yearly_shares(micro):
    # Missing flow counts 0 and still counts in the average
    df = multi.partner_matrix(micro, Params("A", Y, unit="gdp", partners=("G2",)))
    got = [(r.category, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [("X", -7.0, 36.0, 29.0), ("Y", -4.0, 8.0, 4.0)]


def test_q5_zero_cells_are_present(micro):
    # C->B X 2002 is 0.00 but present
    df = multi.partner_matrix(micro, Params("C", Y, partners=("G1",)))
    got = [(r.category, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [("X", -20.0, 8.0, -12.0), ("Y", -6.0, 4.0, -2.0), ("Z", -7.0, 1.0, -6.0)]


def test_q5_year_without_gdp_row_drops(micro, spark):
    # The matrix inner-joins GDP; without C's 2002 row, 2002 disappears
    gdp = micro.gdp.where("NOT (country = 'C' AND year = 2002)")
    cat = replace(micro, gdp=gdp)
    df = multi.partner_matrix(cat, Params("C", Y, partners=("G1",)))
    got = [(r.category, r.imports, r.exports, r.balance) for r in df.collect()]
    assert got == [("X", 0.0, 8.0, 8.0), ("Y", -6.0, 0.0, -6.0), ("Z", 0.0, 1.0, 1.0)]


def test_q6_report_shares_one_slice(micro):
    rep = single.single_report(micro, Params("A", Y))
    try:
        assert rows(rep["partners"], "partner", "value") == [("B", 27.0), ("C", 26.0)]
        assert rows(rep["categories"], "category", "value") == [("X", 42.0), ("Y", 11.0)]
        assert rep["world_trade"].count() == 2
    finally:
        single.unpersist_report(rep)


def test_q7_multi_report(micro):
    rep = multi.multi_report(micro, Params("A", Y, partners=("G2",)))
    try:
        assert rep["plot"].count() == 2 and rep["table"].count() == 2
    finally:
        single.unpersist_report(rep)


@pytest.mark.parametrize("unit", ["usd", "cad", "eur", "gbp"])
def test_unit_labels(micro, unit):
    df = single.top_partners(micro, Params("A", Y, unit=unit, prices="constant"))
    assert df.first().unit == f"constant {unit} million"


def test_report_runs_concurrently(spark, micro):
    from corridor.plans.concurrent import fetch_all

    rep = single.single_report(micro, Params("A", Y))
    try:
        got = fetch_all(spark, rep, pool="reports")
    finally:
        single.unpersist_report(rep)
    assert set(got) == {"partners", "categories", "world_trade"}
    assert sorted((r.partner, r.value) for r in got["partners"]) == [("B", 27.0), ("C", 26.0)]
    rep = multi.multi_report(micro, Params("A", Y, partners=("G2",)))
    got = fetch_all(spark, rep)
    single.unpersist_report(rep)
    assert len(got["plot"]) == 2 and len(got["table"]) == 2


def test_large_factor_table_falls_back_to_shuffle_join(micro):
    # a factor table that failed its size check is joined without a broadcast hint; results are unchanged
    cat = replace(micro, broadcastable=frozenset())
    assert rows(single.top_partners(cat, Params("A", Y, prices="constant")), "partner", "value") == [
        ("B", 54.0), ("C", 52.0)]


def test_q3_null_year_share_is_null(spark, micro):
    # L5 + L8: with a 2003 factor for B, its 2003 imports land in the null-year row, which matches no GDP
    # year, so the share is null; B's 2002 GDP is null too, so 2002 shares are null as well
    extra = spark.createDataFrame([(2003, "B", D("1.0000"), D("1.0000"), D("1.0000"), D("1.0000"))],
                                  micro.constant.schema)
    cat = replace(micro, constant=micro.constant.unionByName(extra))
    df = single.world_trade(cat, Params("B", Y, unit="gdp"))
    assert [(r.year, r.imports, r.exports, r.balance) for r in df.collect()] == [
        (2002, None, None, None), (2003, None, None, None), (None, None, None, None)]
    # in money the same null-year row carries the imports
    df = single.world_trade(cat, Params("B", Y, prices="constant"))
    assert [(r.year, r.imports, r.exports, r.balance) for r in df.collect()] == [
        (2002, -22.5, 15.0, -7.5), (2003, None, None, None), (None, -13.0, None, -13.0)]
