"""Operator unit tests on small inline frames, one or more per SURVEY section 2 id."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.functions.labels import rounded_value, unit_text, value_label, years_text
from corridor.functions.measures import to_money
from corridor.functions.text import fix_mojibake, label, slug
from corridor.operators import convert, coverage, membership, normalize, quality, shape
from corridor.params import Params, sanitize_years, select_partners
from corridor.sinks.files import file_name
from corridor.sources import files

D = Decimal


# ---- T1 pieces ----------------------------------------------------------------

@pytest.fixture(scope="module")
def etl_inputs(spark):
    raw = spark.createDataFrame(
        [
            (2002, 1, 2, "010101", 1234.5), (2002, 1, 2, "020202", 0.5),      # 1235.0 -> 1.235 -> 1.24
            (2002, 1, 3, "010101", 1225.0),                                   # 1.225 -> 1.22 (half even)
            (2002, 2, 1, "980000", 50.0),                                     # chapter 98 unmapped
            (2002, 1, 4, "010101", 70.0),                                     # importer 4 not covered
            (2002, 9, 1, "010101", 80.0),                                     # exporter 9 unknown code
            (2003, 3, 1, "030303", 0.004),                                    # rounds to 0.00, kept
            (2003, 3, 2, "030303", None),                                     # all-null group sums to 0
        ],
        "t int, i int, j int, k string, v double",
    )
    sections = spark.createDataFrame([("X", ["01", "02"]), ("Y", ["03"])], "category string, chapters array<string>")
    codes = spark.createDataFrame(
        [(1, "CÃ´te d'Ivoire", "CI", "CIV"), (2, "TÃ¼rkiye", "TR", "TUR"), (3, "Canada", "CA", "CAN"),
         (4, "Nowhere", "NW", "NWH")],
        "country_code int, country_name string, country_iso2 string, country_iso3 string",
    )
    covered = spark.createDataFrame(
        [("Côte d'Ivoire", ["G1"]), ("Türkiye", ["G1", "G2"]), ("Canada", [])], "country string, groups array<string>"
    )
    return raw, sections, codes, covered


def test_build_flows_maps_filters_rounds(etl_inputs):
    raw, sections, codes, covered = etl_inputs
    got = {(r.year, r.exporter, r.importer, r.category): r.value
           for r in normalize.build_flows(raw, sections, codes, covered).collect()}
    assert got == {
        (2002, "Côte d'Ivoire", "Türkiye", "X"): D("1.24"),
        (2002, "Côte d'Ivoire", "Canada", "X"): D("1.22"),
        (2003, "Canada", "Côte d'Ivoire", "Y"): D("0.00"),
        (2003, "Canada", "Türkiye", "Y"): D("0.00"),
    }


def test_etl_audit_accounts_for_every_row(etl_inputs):
    raw, sections, codes, covered = etl_inputs
    r = quality.etl_audit(raw, sections, codes, covered).first()
    assert r.rows_in == 8 == r.rows_kept + r.rows_unmapped + r.rows_bad_exporter + r.rows_bad_importer
    assert (r.rows_kept, r.rows_unmapped, r.rows_bad_exporter, r.rows_bad_importer) == (5, 1, 1, 1)
    assert r.value_in == r.value_kept + r.value_rejected


def test_to_money_is_half_even(spark):
    df = spark.createDataFrame([(D("1235.00"),), (D("1225.00"),), (D("-1225.00"),), (D("1225.01"),)],
                               "x decimal(18,2)")
    assert [r[0] for r in df.select(to_money(F.col("x"))).collect()] == [D("1.24"), D("1.22"), D("-1.22"), D("1.23")]


def test_wide_long_round_trip(spark):
    flows = spark.createDataFrame(
        [(2002, "A", "B", "X", D("1.00")), (2002, "A", "B", "Z", D("0.00")), (2003, "B", "A", "Y", D("2.50"))],
        "year int, exporter string, importer string, category string, value decimal(18,2)")
    wide = normalize.to_wide(flows, ["X", "Y", "Z", "W"])
    assert wide.columns == ["year", "exporter", "importer", "X", "Y", "Z", "W"]  # W never occurs, still a column
    assert dict(wide.dtypes)["X"] == "decimal(18,2)" and dict(wide.dtypes)["year"] == "smallint"
    back = normalize.to_long(wide).orderBy("year", "category").collect()
    assert [(r.year, r.category, r.value) for r in back] == [
        (2002, "X", D("1.00")), (2002, "Z", D("0.00")), (2003, "Y", D("2.50"))]
    assert normalize.duplicate_keys(flows).count() == 0


def test_mojibake_repair_leaves_correct_names_alone(spark):
    names = ["CÃ´te d'Ivoire", "TÃ¼rkiye", "CuraÃ§ao", "Côte d'Ivoire", "Canada", "中国", "Ã", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(fix_mojibake("n")).collect()]
    assert got == ["Côte d'Ivoire", "Türkiye", "Curaçao", "Côte d'Ivoire", "Canada", "中国", "Ã", None]


# ---- sources ------------------------------------------------------------------

def test_json_settings_readers(spark, tmp_path):
    sec = tmp_path / "sections.json"
    sec.write_text(json.dumps({"Animals": ["01", "02"], "Vegetables": ["06"]}))
    cty = tmp_path / "countries.json"
    cty.write_text(json.dumps({"Kenya": {"groups": ["Africa", "G20"]}, "Fiji": {"groups": []}, "Peru": {}}))
    s = normalize.chapter_sections(files.read_sections(spark, str(sec)))
    assert sorted((r.chapter, r.category) for r in s.collect()) == [
        ("01", "Animals"), ("02", "Animals"), ("06", "Vegetables")]
    c = {r.country: r.groups for r in files.read_countries(spark, str(cty)).collect()}
    assert c == {"Kenya": ["Africa", "G20"], "Fiji": [], "Peru": []}


def test_raw_csv_reader_keeps_leading_zeros(spark, tmp_path):
    p = tmp_path / "flows_2002.csv"
    p.write_text("t,i,j,k,v,q\n2002,4,8,010121,12.5,1.0\n2002,4,8,100190,3.25,NA\n")
    df = files.read_raw_flows(spark, files.yearly_paths(str(tmp_path), [2002]))
    assert [(r.k, r.v) for r in df.collect()] == [("010121", 12.5), ("100190", 3.25)]


# ---- T2 and group operators -----------------------------------------------------

@pytest.fixture(scope="module")
def mem(spark):
    countries = spark.createDataFrame(
        [("A", ["G1"]), ("B", ["G1", "G2"]), ("C", ["G2"]), ("D", [])], "country string, groups array<string>")
    return membership.build_membership(countries)


def test_membership_inverts_and_adds_singletons(mem):
    got = sorted((r.group_name, r.country) for r in mem.collect())
    assert got == [("A", "A"), ("B", "B"), ("C", "C"), ("D", "D"), ("G1", "A"), ("G1", "B"), ("G2", "B"), ("G2", "C")]


def test_group_catalogue(mem):
    got = [(r.group_name, r.n_members, r.members) for r in membership.group_catalogue(mem).orderBy("group_name").collect()]
    assert got == [("G1", 2, "A, B"), ("G2", 2, "B, C")]


def test_valid_counterparts_excludes_overlap(mem):
    assert sorted(r[0] for r in membership.valid_counterparts(mem, "G1").collect()) == ["C", "D"]
    assert sorted(r[0] for r in membership.rest_of_sample(mem, "G2").collect()) == ["A", "D"]


def test_members_of_unknown_name_is_itself():
    groups = {"G1": ("A", "B")}
    assert membership.members_of(groups, "G1") == ("A", "B")
    assert membership.members_of(groups, ["G1", "Z"]) == ("A", "B", "Z")


# ---- T3/T4 factors, T5/T6 gdp and coverage --------------------------------------

def test_current_factors_keep_years_without_rate(spark):
    fx = spark.createDataFrame([("usd", 2002, 1.0), ("eur", 2002, 0.9), ("usd", 2003, 1.0)],
                               "currency string, year int, per_usd double")
    years = spark.createDataFrame([(2002,), (2003,), (2004,)], "year int")
    got = {r.year: (r.usd_current, r.eur_current) for r in convert.build_current_factors(fx, years).collect()}
    assert got == {2002: (1.0, 0.9), 2003: (1.0, None), 2004: (None, None)}


def test_constant_factors_formula_and_thresh(spark):
    scaffold = spark.createDataFrame([(2002, "A"), (2003, "A"), (2002, "B")], "year int, country string")
    defl = spark.createDataFrame([("A", 2002, 0.8, 2.0), ("A", 2003, 1.0, 4.0), ("B", 2003, 1.0, 1.0)],
                                 "country string, year int, deflator double, lcu_per_usd double")
    fx = spark.createDataFrame([(c, 2003, r) for c, r in [("usd", 1.0), ("cad", 1.5), ("eur", 0.5), ("gbp", 0.25)]],
                               "currency string, year int, per_usd double")
    out = {(r.year, r.country): r for r in convert.build_constant_factors(scaffold, defl, fx, 2003).collect()}
    # A 2002: 2.0 / (0.8 / 1.0) / 4.0 = 0.625 USD-equivalents of 2003
    assert out[(2002, "A")].usd_constant == pytest.approx(0.625)
    assert out[(2002, "A")].cad_constant == pytest.approx(0.9375)
    assert out[(2003, "A")].gbp_constant == pytest.approx(0.25)
    assert (2002, "B") not in out  # no deflator row: every factor null -> dropped


def test_gdp_and_coverage(spark):
    scaffold = spark.createDataFrame([(2003, "Kenya"), (2003, "Peru")], "year int, country string")
    ind = spark.createDataFrame(
        [(" kenya ", "NGDPD", "U.S. dollars", 2003, 2.0), ("PERU", "NGDPD", "U.S. dollars", 2003, 3.0),
         ("World", "NGDPD", "U.S. dollars", 2003, 10.0), ("Kenya", "LP", "Persons", 2003, 5.0),
         ("Chad", "LP", "Persons", 2003, 15.0), ("Kenya", "NGDPD", "National currency", 2003, 99.0)],
        "entity_name string, indicator_code string, unit string, year int, value double")
    aliases = spark.createDataFrame([("Kenya", "KEN"), ("Peru", "PER"), ("Chad", "TCD"), ("USA", "USA")],
                                    "alias string, iso3 string")
    defl = spark.createDataFrame([("USA", 2003, 1.0, 1.0)], "country string, year int, deflator double, lcu_per_usd double")
    g = {r.country: r.gdp_constant for r in coverage.build_gdp(scaffold, ind, aliases, defl, "USA", 2003).collect()}
    assert g == {"Kenya": 2000.0, "Peru": 3000.0}
    dup = ind.unionByName(spark.createDataFrame([("Kenya ", "NGDPD", "U.S. dollars", 2003, 7.0)], ind.schema))
    with pytest.raises(ValueError):
        coverage.build_gdp(scaffold, dup, aliases, defl, "USA", 2003)
    countries = spark.createDataFrame([("Kenya",), ("Peru",)], "country string")
    c = coverage.build_coverage(countries, ind, aliases, 2003).first()
    assert (c.n_countries, c.gdp_share, c.pop_share) == (2, 50.0, 25.0)


def test_missing_factors_audit(micro):
    from corridor.plans.core import sided

    p = Params("B", (2002, 2003), prices="constant")
    view = sided(micro, p, micro.members("B"), ("exports", "imports"))
    fac = micro.constant.select("year", F.col("country").alias("reporter"))
    assert [tuple(r) for r in quality.missing_factors(view, fac, ["year", "reporter"]).collect()] == [(2003, "B")]


# ---- shaping --------------------------------------------------------------------

@pytest.fixture(scope="module")
def q1_like(spark):
    return spark.createDataFrame(
        [("B", "exports", 27.0), ("C", "exports", 26.0), ("D", "exports", 27.0), ("B", "imports", -5.0),
         ("C", "imports", -9.0)], "partner string, flow string, value double")


def test_rank_table(q1_like):
    got = [tuple(r) for r in shape.rank_table(q1_like, "exports", "partner").orderBy("rank").collect()]
    assert got == [("B", 27.0, 1), ("D", 27.0, 2), ("C", 26.0, 3)]
    got = [tuple(r) for r in shape.rank_table(q1_like, "imports", "partner", k=1).collect()]
    assert got == [("C", -9.0, 1)]


def test_bar_share(q1_like):
    r = {x.partner: x for x in shape.bar_share(q1_like.where("flow = 'imports'"), "value").collect()}
    assert r["C"].bar_width == pytest.approx(100.0 * 9 / 14) and r["C"].zero_position == pytest.approx(9 / 14)


def test_series_long_and_flags(spark):
    df = spark.createDataFrame(
        [(2002, "P", -1.0, 2.0, 1.0), (2003, "P", None, None, None), (2004, "P", -1.0, None, -1.0),
         (2002, "Q", None, None, None), (2003, "Q", -2.0, 1.0, -1.0), (None, "R", -3.0, None, -3.0)],
        "year int, partner string, imports double, exports double, balance double")
    long = shape.series_long(df)
    assert long.count() == 10 and long.where("value IS NULL").count() == 0
    assert str(long.where("year = 2002 AND partner = 'P'").first().date) == "2002-01-01"
    flags = {r.partner: (r.has_break, r.single_value) for r in shape.series_flags(df).collect()}
    assert flags == {"P": (True, False), "Q": (False, True), "R": (False, True)}


def test_partner_pivot_and_limits(spark):
    df = spark.createDataFrame([("X", "G1", 1.0), ("X", "G2", -4.0), ("Y", "G1", 3.0)],
                               "category string, partner string, exports double")
    piv = shape.partner_pivot(df, "exports", ["G1", "G2", "G3"])
    assert [tuple(r) for r in piv.collect()] == [("X", 1.0, -4.0, None), ("Y", 3.0, None, None)]
    lim = shape.table_limits(piv).first()
    assert (lim.min_value, lim.max_value) == (-4.0, 3.0)
    assert shape.table_single(spark.createDataFrame(
        [("X", -1.0, 5.0, 4.0, "u"), ("Y", None, 9.0, 9.0, "u")],
        "category string, imports double, exports double, balance double, unit string")).first().category == "Y"


# ---- labels and parameters ---------------------------------------------------------

def test_value_labels(spark):
    vals = [None, 0.0, 0.004, -0.004, 1234.5, -1234567.126, 1.005, 12.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [(r.s, r.l) for r in df.select(rounded_value("v").alias("s"), value_label("v").alias("l")).collect()]
    assert got == [(0.0, "0"), (0.0, "0"), (0.0, "< 0.01"), (0.0, "> -0.01"), (1234.5, "1,234.5"),
                   (-1234567.13, "-1,234,567.13"), (1.01, "1.01"), (12.0, "12.0")]


def test_unit_text_and_words(spark):
    df = spark.createDataFrame([("usd",), ("eur",), ("gdp",)], "u string")
    assert [r[0] for r in df.select(unit_text("u")).collect()] == ["US$ Million", "€ Million", " % of GDP"]
    assert [r[0] for r in df.select(unit_text("u", long=False, value=F.lit("5.0"))).collect()] == [
        "US$5.0 M", "€5.0 M", "5.0 % of GDP"]
    w = spark.createDataFrame([("balance",), ("exports",), ("All countries",)], "w string")
    assert [r[0] for r in w.select(label("w")).collect()] == ["Trade balance", "Exports", "All countries"]
    assert [r[0] for r in w.select(label("w", in_sentence=True, capitalize=False)).collect()] == [
        "trade balance with", "exports to", "All countries"]
    assert [r[0] for r in w.select(slug("w")).collect()] == ["balance", "exports", "all_countries"]
    assert years_text(2003, 2003) == "2003" and years_text(2002, 2003) == "2002-2003"


def test_file_names():
    p = Params("South Africa", (2002, 2023), category="Animal products")
    assert file_name("top_partners", p).startswith("top_partners-south_africa-animal_products-exports-usd_current-2002_2023-")
    assert file_name("top_partners", Params("Kenya", (2020, 2020), unit="gdp")).startswith("top_partners-kenya-exports-gdp-2020-")
    others = [p.with_(unit="eur"), p.with_(prices="constant"), p.with_(group="G7"), p.with_(unit="gdp"), p.with_(flow="imports"),
              p.with_(partners=("A", "B")), p.with_(partners=("A B",)), p.with_(category="animal products")]
    names = [file_name(q, x) for q in ("top_partners", "top_categories") for x in (p, *others)]
    assert len(set(names)) == len(names)


def test_params_validation():
    p = Params("A", (2005, 2002), unit="gdp", prices="current")
    assert p.years == (2002, 2005) and p.factor_column == "usd_constant" and p.per_country_factor
    assert Params("A", (1, 2), unit="eur").factor_column == "eur_current"
    with pytest.raises(ValueError):
        Params("A", (1, 2), unit="jpy")
    assert sanitize_years(float("nan"), 3000, (2002, 2023)) == (2002, 2023)
    assert sanitize_years(2010, 2004, (2002, 2023)) == (2004, 2010)
    assert select_partners(["a", "x", "b", "a", "c", "d", "e"], "abcdef") == ("a", "b", "c", "d", "e")
    with pytest.raises(ValueError):
        select_partners("abcdef", "abcdef")


def test_share_of_zero_gdp_is_null(spark):
    from corridor.functions.measures import share

    df = spark.createDataFrame([(D("5.00"), 0.0), (D("5.00"), 200.0), (D("5.00"), None)], "x decimal(18,2), g double")
    got = [r[0] for r in df.select(share(F.col("x"), F.col("g"))).collect()]
    assert got[0] is None and got[1] == 2.5 and got[2] is None
    assert not any(isinstance(v, float) and math.isinf(v) for v in got if v is not None)


def test_typed_table_readers(spark, tmp_path):
    (tmp_path / "cov.csv").write_text("n_countries,gdp_share,pop_share\n112,86.25,70.5\n")
    r = files.read_coverage(spark, str(tmp_path / "cov.csv")).first()
    assert (r.n_countries, r.gdp_share, r.pop_share) == (112, 86.25, 70.5)
    (tmp_path / "ind.csv").write_text("entity_name,indicator_code,unit,year,value\nKenya,LP,Persons,2020,53.0\n")
    ind = files.read_indicators(spark, str(tmp_path / "ind.csv"), fmt="csv")
    assert ind.dtypes == [("entity_name", "string"), ("indicator_code", "string"), ("unit", "string"),
                          ("year", "int"), ("value", "double")]
    (tmp_path / "const.csv").write_text("year,country,usd_constant,cad_constant,eur_constant,gbp_constant\n"
                                        "2020,Kenya,1.5,,2,2.5\n")
    c = files.read_factor_table(spark, str(tmp_path / "const.csv"), "constant").first()
    assert (c.year, c.country, c.usd_constant, c.cad_constant) == (2020, "Kenya", 1.5, None)
    files.register_tables(spark, {"coverage_t": files.read_coverage(spark, str(tmp_path / "cov.csv"))})
    assert spark.sql("SELECT n_countries FROM coverage_t").first()[0] == 112
    assert [r.value for r in files.literal_relation(spark, ["a", "b"]).collect()] == ["a", "b"]


def test_wide_view_overflow_fails_loudly(spark):
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        pytest.skip("overflow raises only under ANSI mode")
    flows = spark.createDataFrame([(2002, "A", "B", "X", D("1000000.00"))],
                                  "year int, exporter string, importer string, category string, value decimal(18,2)")
    assert normalize.to_wide(flows, ["X"]).first().X == D("1000000.00")
    with pytest.raises(Exception):
        normalize.to_wide(flows, ["X"], value_type=T.DecimalType(8, 2)).collect()


def test_wide_view_rejects_repeated_cells_in_one_shuffle(spark):
    row = (2002, "A", "B", "X", D("1.00"))
    schema = "year int, exporter string, importer string, category string, value decimal(18,2)"
    with pytest.raises(Exception, match="several rows for one cell"):
        normalize.to_wide(spark.createDataFrame([row, row], schema), ["X"]).collect()
    plan = normalize.to_wide(spark.createDataFrame([row], schema), ["X"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_csv_readers_go_by_header_and_fail_on_bad_cells(spark, tmp_path):
    inputs = {
        "raw": (files.read_raw_flows, {"t": "2002", "i": "1", "j": "2", "k": "0101", "v": "1.5", "q": "x"}, "v"),
        "codes": (files.read_country_codes, {"country_code": "1", "country_name": "A", "country_iso2": "a", "country_iso3": "AAA"}, "country_code"),
        "ind": (lambda s, p: files.read_indicators(s, p, "csv"), {"entity_name": "A", "indicator_code": "LP", "unit": "u", "year": "2002", "value": "2"}, "year"),
        "cov": (files.read_coverage, {"n_countries": "3", "gdp_share": "1.5", "pop_share": "2.5"}, "gdp_share"),
        "gdp": (lambda s, p: files.read_factor_table(s, p, "gdp"), {"year": "2002", "country": "A", "gdp_constant": "5"}, "gdp_constant"),
        "cur": (lambda s, p: files.read_factor_table(s, p, "current"),
                {"year": "2002", **{f"{c}_current": str(n) for n, c in enumerate(("usd", "cad", "eur", "gbp"))}}, "eur_current"),
    }
    for name, (read, row, number) in inputs.items():
        straight, turned, bad = (tmp_path / f"{name}{k}.csv" for k in range(3))
        straight.write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
        back = dict(reversed(row.items()))
        turned.write_text(",".join(back) + ",extra\n" + ",".join(back.values()) + ",1\n")
        assert read(spark, str(turned)).collect() == read(spark, str(straight)).collect(), name
        bad.write_text(",".join(row) + "\n" + ",".join({**row, number: "oops"}.values()) + "\n")
        with pytest.raises(Exception):
            read(spark, str(bad)).collect()
        bad.write_text(",".join(list(row)[1:]) + "\n")
        with pytest.raises(ValueError, match="no column"):
            read(spark, str(bad))
    both = files.read_raw_flows(spark, [str(tmp_path / "raw0.csv"), str(tmp_path / "raw1.csv")]).collect()
    assert both[0] == both[1]


def test_repeated_alias_raises(spark):
    df = spark.createDataFrame([("Kenya",)], "name string")
    al = spark.createDataFrame([("Kenya", "KEN"), (" kenya", "KEN")], "alias string, iso3 string")
    assert coverage.resolve_names(df, "name", al).collect()[0].iso3 == "KEN"
    al = spark.createDataFrame([("Kenya", "KEN"), ("KENYA ", "XXX")], "alias string, iso3 string")
    with pytest.raises(Exception, match="several iso3 codes"):
        coverage.resolve_names(df, "name", al).collect()
    audit = coverage.name_resolution_audit(df.union(df).union(spark.createDataFrame([("Nowhere",)], "n string")), "name", al.limit(1))
    assert sorted(map(tuple, audit.collect())) == [("Kenya", "KEN", 2, True), ("Nowhere", None, 1, False)]


def test_ranks_of_a_million_rows_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(1_000_000).select(F.col("id").cast("string").alias("partner"), F.lit("exports").alias("flow"),
                                           F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("value"))
        r = shape.rank_table(df, "exports", "partner").agg(F.count("rank"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
        assert tuple(r) == (1_000_000, 1_000_000, 1, 1_000_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("parts", ["8", "37"])
def test_distributed_rank_matches_a_global_window(spark, parts):
    from pyspark.sql import Window

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(5000).select(
            F.format_string("P%05d", "id").alias("partner"), F.lit("exports").alias("flow"),
            (F.abs(F.hash("id")) % 997).cast("double").alias("value"))  # many ties, broken by partner
        got = {r.partner: r.rank for r in shape.rank_table(df, "exports", "partner").collect()}
        ref = df.select("partner", F.row_number().over(
            Window.orderBy(F.desc("value"), F.asc("partner"))).alias("rank"))
        assert got == {r.partner: r.rank for r in ref.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
