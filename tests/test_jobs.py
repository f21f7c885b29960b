"""The production path: files on disk -> serving tables -> report queries -> export."""

from __future__ import annotations

import json

from corridor import cli
from corridor.params import Params
from corridor.plans import jobs, multi, single


def _inputs(d):
    raw = d / "raw"
    raw.mkdir()
    (raw / "flows_2002.csv").write_text(
        "t,i,j,k,v,q\n2002,1,2,010101,10000,1\n2002,1,3,060101,20000,1\n2002,2,1,010101,3000,1\n"
        "2002,1,2,980000,500,1\n2002,1,9,010101,700,1\n")
    (raw / "flows_2003.csv").write_text(
        "t,i,j,k,v,q\n2003,1,2,010101,12000,1\n2003,3,1,060101,8000,1\n")
    (d / "codes.csv").write_text(
        "country_code,country_name,country_iso2,country_iso3\n1,Kenya,KE,KEN\n2,TÃ¼rkiye,TR,TUR\n3,Peru,PE,PER\n"
        "9,Chad,TD,TCD\n")
    (d / "sections.json").write_text(json.dumps({"Animals": ["01"], "Plants": ["06"]}))
    (d / "countries.json").write_text(json.dumps(
        {"Kenya": {"groups": ["Africa"]}, "Türkiye": {"groups": ["G20"]}, "Peru": {"groups": ["G20"]}}))
    (d / "cur.csv").write_text("year,usd_current,cad_current,eur_current,gbp_current\n2002,1,1.5,0.5,0.4\n"
                               "2003,1,1.4,0.8,0.5\n")
    (d / "const.csv").write_text("year,country,usd_constant,cad_constant,eur_constant,gbp_constant\n"
                                 "2002,Kenya,2,2,2,2\n2003,Kenya,2,2,2,2\n")
    (d / "gdp.csv").write_text("year,country,gdp_constant\n2002,Kenya,100\n2003,Kenya,200\n")


def test_build_and_query(spark, tmp_path):
    _inputs(tmp_path)
    raw = sorted(str(p) for p in (tmp_path / "raw").iterdir())
    cat = jobs.build_serving_tables(
        spark, raw_paths=raw, country_codes=str(tmp_path / "codes.csv"), sections=str(tmp_path / "sections.json"),
        countries=str(tmp_path / "countries.json"), current=str(tmp_path / "cur.csv"),
        constant=str(tmp_path / "const.csv"), gdp=str(tmp_path / "gdp.csv"), out_root=str(tmp_path / "serving"),
        time_range=(2002, 2003), wide=True)
    assert cat.flows.count() == 5  # 98 unmapped and uncovered Chad dropped
    wide = spark.read.parquet(jobs.serving_root(spark, str(tmp_path / "serving")) + "/flows_wide")
    assert sorted(wide.columns) == ["Animals", "Plants", "exporter", "importer", "year"]
    assert wide.count() == 5
    assert cat.groups["G20"] == ("Peru", "Türkiye")
    got = {r.partner: r.value for r in single.top_partners(cat, Params("Kenya", (2002, 2003))).collect()}
    assert got == {"Türkiye": 22.0, "Peru": 20.0}
    got = {r.partner: r.value for r in single.top_partners(
        cat, Params("Kenya", (2002, 2003), prices="constant")).collect()}
    assert got == {"Türkiye": 44.0, "Peru": 40.0}
    m = multi.partner_matrix(cat, Params("Kenya", (2002, 2003), partners=("G20",))).collect()
    assert [(r.category, r.imports, r.exports) for r in m] == [("Animals", -3.0, 22.0), ("Plants", -8.0, 20.0)]

    cli.main(["query", "top_partners", "--root", str(tmp_path / "serving"), "--country", "Kenya",
              "--years", "2002", "2003", "--export", str(tmp_path / "out")])
    (out,) = (tmp_path / "out").iterdir()
    assert out.name.startswith("top_partners-kenya-exports-usd_current-2002_2003-")
    assert spark.read.option("header", True).csv(str(out)).count() == 2


def test_builder_commands(spark, tmp_path):
    (tmp_path / "countries.json").write_text(json.dumps({"Kenya": {"groups": ["Africa"]}, "Peru": {"groups": []}}))
    (tmp_path / "fx.csv").write_text("currency,year,per_usd\nusd,2002,1\nusd,2003,1\ncad,2002,1.5\ncad,2003,1.4\n"
                                     "eur,2003,0.9\ngbp,2003,0.6\n")
    (tmp_path / "defl.csv").write_text("country,year,deflator,lcu_per_usd\nKenya,2002,0.8,2\nKenya,2003,1,4\n"
                                       "Peru,2002,0.5,1\nPeru,2003,1,1\nUSA,2002,0.9,1\nUSA,2003,1,1\n")
    (tmp_path / "ind.csv").write_text("entity_name,indicator_code,unit,year,value\n"
                                      "Kenya,NGDPD,U.S. dollars,2003,1.0\nPeru,NGDPD,U.S. dollars,2003,3.0\n"
                                      "World,NGDPD,U.S. dollars,2003,8.0\nKenya,LP,Persons,2003,1.0\n"
                                      "Peru,LP,Persons,2003,1.0\nChad,LP,Persons,2003,2.0\n")
    (tmp_path / "aliases.csv").write_text("alias,iso3\nKenya,KEN\nPeru,PER\nChad,TCD\n")
    t = str(tmp_path)
    cli.main(["current-factors", "--fx", f"{t}/fx.csv", "--years", "2002", "2003", "--out", f"{t}/cur"])
    cur = {r.year: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{t}/cur").collect()}
    assert cur[2002].cad_current == 1.5 and cur[2002].eur_current is None
    cli.main(["constant-factors", "--countries", f"{t}/countries.json", "--deflators", f"{t}/defl.csv",
              "--fx", f"{t}/fx.csv", "--years", "2002", "2003", "--base-year", "2003", "--out", f"{t}/const"])
    const = spark.read.option("header", True).option("inferSchema", True).csv(f"{t}/const")
    r = const.where("country = 'Kenya' AND year = 2002").first()
    assert abs(r.usd_constant - 0.625) < 1e-12 and abs(r.cad_constant - 0.875) < 1e-12
    cli.main(["gdp", "--countries", f"{t}/countries.json", "--indicators", f"{t}/ind.csv", "--aliases",
              f"{t}/aliases.csv", "--deflators", f"{t}/defl.csv", "--base-country", "USA", "--years", "2002", "2003",
              "--base-year", "2003", "--out", f"{t}/gdp"])
    gdp = {(r.year, r.country): r.gdp_constant
           for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{t}/gdp").collect()}
    assert gdp[(2003, "Peru")] == 3000.0 and gdp[(2002, "Kenya")] is None
    cli.main(["coverage", "--countries", f"{t}/countries.json", "--indicators", f"{t}/ind.csv", "--aliases",
              f"{t}/aliases.csv", "--year", "2003", "--out", f"{t}/cov"])
    cov = spark.read.option("header", True).option("inferSchema", True).csv(f"{t}/cov").first()
    assert (cov.n_countries, cov.gdp_share, cov.pop_share) == (2, 50.0, 50.0)
