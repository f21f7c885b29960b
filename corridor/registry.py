"""Named queries over a test-data directory, each with its oracle SQL.

Every entry reads the driver's tables (or the serving tables Spark builds
from them) in full; parameters only choose reporter, partners, unit, prices,
years and category, as a user of the product would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .checks import oracle, oracle_ops
from .functions.labels import rounded_value, unit_text, value_label
from .functions.text import fix_mojibake, fix_mojibake_repeated, label, slug
from .operators import convert, coverage, membership, names, normalize, quality, rejects, shape
from .params import Params, sanitize_years, select_partners
from .plans import jobs, multi, refresh, sets, single, sql
from .plans.catalog import fixture_catalog, fixture_file_build, fixture_flows, fixture_refreshed, fixture_sources
from .plans.core import sided
from .schemas import COVERAGE
from .session import shared_dir
from .sinks.files import export_result, file_name, write_table
from .sources import files, fixture, fixture_files

YEARS = (1995, 2001)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, run, sql=None) -> None:
    if name in REGISTRY:
        raise KeyError(name)
    REGISTRY[name] = Entry(run, sql)


def _q(fn, p: Params, **kw):
    return lambda spark, d: fn(fixture_catalog(spark, d), p, **kw)


# ---- Q1 top partners ---------------------------------------------------------
_Q1 = {
    "top_partners_exports_current": Params("NATION_1", YEARS, unit="usd", prices="current", flow="exports"),
    "top_partners_imports_current": Params("NATION_1", YEARS, unit="eur", prices="current", flow="imports"),
    "top_partners_exports_constant": Params("NATION_5", YEARS, unit="cad", prices="constant", flow="exports"),
    "top_partners_imports_constant": Params("NATION_3", YEARS, unit="eur", prices="constant", flow="imports"),
    "top_partners_exports_gdp": Params("NATION_9", YEARS, unit="gdp", flow="exports"),
    "top_partners_imports_gdp": Params("AMERICA", (1996, 2000), unit="gdp", flow="imports"),
    "top_partners_in_group": Params("NATION_2", YEARS, unit="usd", flow="exports", group="EUROPE"),
    "top_partners_group_reporter": Params("ASIA", (1997, 2001), unit="gbp", flow="exports", category="S11"),
    "top_partners_one_category": Params("NATION_0", YEARS, unit="usd", flow="imports", category="S19"),
}
for _n, _p in _Q1.items():
    register(_n, _q(single.top_partners, _p), lambda p=_p: oracle.top_partners(p))

# ---- Q2 top categories -------------------------------------------------------
_Q2 = {
    "top_categories_current": Params("NATION_4", YEARS, unit="usd", flow="exports"),
    "top_categories_constant": Params("BLOC_A", (1996, 2001), unit="cad", prices="constant", flow="imports"),
    "top_categories_gdp": Params("NATION_9", YEARS, unit="gdp", flow="exports"),
    "top_categories_in_group": Params("EUROPE", YEARS, unit="gbp", flow="imports", group="BLOC_B"),
    "top_categories_one_year": Params("NATION_12", (1999, 1999), unit="gdp", flow="imports"),
}
for _n, _p in _Q2.items():
    register(_n, _q(single.top_categories, _p), lambda p=_p: oracle.top_categories(p))

# ---- Q3 world trade ----------------------------------------------------------
_Q3 = {
    "world_trade_current": (Params("NATION_0", YEARS, unit="usd"), False),
    "world_trade_constant": (Params("NATION_5", YEARS, unit="eur", prices="constant"), False),
    "world_trade_gdp": (Params("EUROPE", YEARS, unit="gdp"), False),
    "world_trade_group": (Params("BLOC_B", YEARS, unit="cad"), False),
    "world_trade_one_category": (Params("NATION_0", YEARS, unit="usd", category="S19"), False),
    "world_trade_group_category": (Params("AFRICA", YEARS, unit="gdp", category="S03"), False),
    "world_trade_fixed": (Params("NATION_0", YEARS, unit="usd", category="S19"), True),
    "world_trade_fixed_gdp": (Params("ASIA", YEARS, unit="gdp", category="S03"), True),
    "world_trade_one_year": (Params("BLOC_A", (1998, 1998), unit="gbp", prices="constant"), False),
}
for _n, (_p, _f) in _Q3.items():
    register(_n, _q(single.world_trade, _p, fixed=_f), lambda p=_p, f=_f: oracle.world_trade(p, f))

# ---- Q4 partner series, Q5 partner x category matrix -------------------------
_MULTI = {
    "current": Params("NATION_1", YEARS, unit="usd", partners=("EUROPE", "NATION_2")),
    "constant": Params("NATION_8", YEARS, unit="eur", prices="constant", partners=("BLOC_A", "AFRICA")),
    "gdp": Params("NATION_9", YEARS, unit="gdp", partners=("ASIA", "NATION_0")),
    "overlap": Params("NATION_8", (1996, 2000), unit="gbp", category="S03",
                      partners=("BLOC_A", "BLOC_B", "AFRICA")),
    "missing_factor": Params("NATION_5", YEARS, unit="cad", prices="constant", partners=("AMERICA", "NATION_7")),
    "group_reporter": Params("EUROPE", (1996, 2000), unit="gdp", partners=("AFRICA", "NATION_2", "BLOC_A")),
    "one_year": Params("MIDDLE EAST", (2001, 2001), unit="eur", partners=("AMERICA", "ASIA")),
}
for _n, _p in _MULTI.items():
    _g = list(dict.fromkeys(_p.partners))
    register(f"partner_series_{_n}", _q(multi.partner_series, _p), lambda p=_p, g=_g: oracle.partner_series(p, g))
    register(f"partner_matrix_{_n}", _q(multi.partner_matrix, _p), lambda p=_p, g=_g: oracle.partner_matrix(p, g))


# ---- T1 ETL, wide/long views, ETL accounting ---------------------------------
def _cats(spark, d):
    return fixture_catalog(spark, d).categories


register("etl_flows_long", lambda spark, d: fixture_flows(spark, d), oracle_ops.etl_flows_long)
register("etl_flows_wide", lambda spark, d: normalize.to_wide(fixture_catalog(spark, d).flows, _cats(spark, d)),
         oracle_ops.etl_flows_wide)
register("etl_wide_to_long",
         lambda spark, d: normalize.to_long(normalize.to_wide(fixture_catalog(spark, d).flows, _cats(spark, d))),
         oracle_ops.etl_wide_to_long)


def _audit(spark, d):
    s = fixture_sources(spark, d)
    return quality.etl_audit(s["raw"], s["sections"], s["country_codes"], s["countries"])


register("etl_audit", _audit, oracle_ops.etl_audit)

# ---- T2 dimensions and group operators ---------------------------------------
# the section map applied to the chapters that occur in the order lines
register("dim_sections", lambda spark, d: normalize.chapter_coverage(
    fixture_sources(spark, d)["raw"], fixture.sections(spark)).where(F.col("category").isNotNull()).select(
    "chapter", "category"), oracle_ops.dim_sections)
register("section_coverage", lambda spark, d: normalize.chapter_coverage(
    fixture_sources(spark, d)["raw"], fixture.sections(spark)), oracle_ops.section_coverage)
register("dim_countries", lambda spark, d: normalize.country_names(
    fixture.country_codes(spark, d), fixture.countries(spark, d)), oracle_ops.dim_countries)
register("dim_membership", lambda spark, d: membership.build_membership(fixture.countries(spark, d)),
         oracle_ops.dim_membership)
register("dim_group_members", lambda spark, d: membership.group_members(
    membership.build_membership(fixture.countries(spark, d))).select(
    "group_name", F.array_join("members", ", ").alias("members"), "n_members"), oracle_ops.dim_group_members)
register("group_catalogue", lambda spark, d: membership.group_catalogue(
    membership.build_membership(fixture.countries(spark, d))), oracle_ops.group_catalogue)
register("valid_counterparts", lambda spark, d: membership.valid_counterparts(
    membership.build_membership(fixture.countries(spark, d)), "EUROPE"),
    lambda: oracle_ops.valid_counterparts("EUROPE"))
register("rest_of_sample", lambda spark, d: membership.rest_of_sample(
    membership.build_membership(fixture.countries(spark, d)), "BLOC_A"),
    lambda: oracle_ops.rest_of_sample("BLOC_A"))

register("dim_true_groups", lambda spark, d: membership.group_catalogue(
    membership.build_membership(fixture.countries(spark, d))).select("group_name", "n_members"),
    oracle_ops.dim_true_groups)
register("slugs", lambda spark, d: membership.build_membership(fixture.countries(spark, d)).select(
    "group_name").distinct().select("group_name", slug("group_name").alias("slug"),
                                    label("group_name", file_mode=True).alias("file_label")),
    oracle_ops.slugs)

# ---- T3-T6 factor, GDP and coverage builders ---------------------------------
register("gdp_table", lambda spark, d: fixture_catalog(spark, d).gdp, oracle_ops.gdp_table)
register("factor_current", lambda spark, d: convert.build_current_factors(
    fixture.fx(spark, fixture.observed_years(spark, d)), fixture.observed_years(spark, d)),
    oracle_ops.factor_current)
register("factor_constant", lambda spark, d: convert.build_constant_factors(
    fixture.scaffold(spark, d), fixture.deflators(spark, d), fixture.fx(spark, fixture.years(spark, d)), fixture.BASE_YEAR),
    oracle_ops.factor_constant)
register("gdp_build", lambda spark, d: coverage.build_gdp(
    fixture.scaffold(spark, d), fixture.indicators(spark, d), fixture.aliases(spark, d),
    fixture.deflators(spark, d), "NATION_0", fixture.BASE_YEAR), lambda: oracle_ops.gdp_build("NATION_0"))
register("coverage", lambda spark, d: coverage.build_coverage(
    fixture.countries(spark, d), fixture.indicators(spark, d), fixture.aliases(spark, d), fixture.BASE_YEAR),
    lambda: oracle_ops.coverage(fixture.BASE_YEAR))
register("coverage_display", lambda spark, d: coverage.coverage_display(coverage.build_coverage(
    fixture.countries(spark, d), fixture.indicators(spark, d), fixture.aliases(spark, d), fixture.BASE_YEAR)),
    lambda: oracle_ops.coverage_display(fixture.BASE_YEAR))
register("sample_note", lambda spark, d: coverage.sample_note(coverage.build_coverage(
    fixture.countries(spark, d), fixture.indicators(spark, d), fixture.aliases(spark, d), fixture.BASE_YEAR),
    membership.build_membership(fixture.countries(spark, d)), "EUROPE"),
    lambda: oracle_ops.sample_note(fixture.BASE_YEAR, "EUROPE"))
register("random_counterparts", lambda spark, d: membership.random_counterparts(
    membership.build_membership(fixture.countries(spark, d)), "ASIA", n=5, seed=42),
    lambda: oracle_ops.random_counterparts("ASIA", 5, 42))
register("name_resolution_audit", lambda spark, d: coverage.name_resolution_audit(
    fixture.indicators(spark, d), "entity_name", fixture.aliases(spark, d)), oracle_ops.name_resolution_audit)


def _missing(spark, d):
    cat = fixture_catalog(spark, d)
    p = Params("BLOC_A", YEARS, unit="usd", prices="constant")
    view = sided(cat, p, cat.members(p.country), ("exports", "imports"))
    fac = cat.constant.select("year", F.col("country").alias("reporter"))
    return quality.missing_factors(view, fac, ["year", "reporter"])


register("missing_factors", _missing, lambda: oracle_ops.missing_factors("BLOC_A", YEARS))

# ---- R1-R3 shaping and labels over query results ------------------------------
_RANK_P = Params("EUROPE", YEARS, unit="usd", flow="exports")
_RANK_C = Params("NATION_8", YEARS, unit="eur", prices="constant", flow="imports")
_GAPS = Params("NATION_0", YEARS, unit="usd", category="S19", partners=("NATION_5", "AFRICA", "BLOC_B"))
_SINGLE = Params("NATION_8", YEARS, unit="usd", partners=("NATION_13",))


def _on(fn, p):
    return lambda spark, d: fn(fixture_catalog(spark, d), p)


register("rank_partners", lambda spark, d: shape.rank_table(_on(single.top_partners, _RANK_P)(spark, d),
                                                            "exports", "partner"),
         lambda: oracle_ops.rank_table(oracle.top_partners(_RANK_P), "exports", "partner"))
register("rank_categories_top5", lambda spark, d: shape.rank_table(_on(single.top_categories, _RANK_C)(spark, d),
                                                                   "imports", "category", k=5),
         lambda: oracle_ops.rank_table(oracle.top_categories(_RANK_C), "imports", "category", 5))
register("rank_categories", lambda spark, d: shape.rank_table(_on(single.top_categories, _RANK_C)(spark, d),
                                                              "imports", "category"),
         lambda: oracle_ops.rank_table(oracle.top_categories(_RANK_C), "imports", "category"))
register("bar_share", lambda spark, d: shape.bar_share(
    shape.rank_table(_on(single.top_partners, _RANK_P)(spark, d), "exports", "partner"), "exports"),
    lambda: oracle_ops.bar_share(oracle_ops.rank_table(oracle.top_partners(_RANK_P), "exports", "partner"),
                                 "exports"))
_MC = _MULTI["current"]
register("series_long", lambda spark, d: shape.series_long(_on(multi.partner_series, _MC)(spark, d)),
         lambda: oracle_ops.series_long(oracle.partner_series(_MC, list(_MC.partners))))
register("series_one_flow", lambda spark, d: shape.series_points(
    shape.series_long(_on(multi.partner_series, _GAPS)(spark, d)), "balance", nonzero=True),
    lambda: oracle_ops.series_one_flow(oracle.partner_series(_GAPS, list(_GAPS.partners)), "balance"))
register("series_gaps", lambda spark, d: shape.series_flags(_on(multi.partner_series, _GAPS)(spark, d)),
         lambda: oracle_ops.series_flags(oracle.partner_series(_GAPS, list(_GAPS.partners))))
_WT = _Q3["world_trade_one_category"][0]
register("series_gaps_world", lambda spark, d: shape.series_flags(_on(single.world_trade, _WT)(spark, d)),
         lambda: oracle_ops.series_flags(oracle.world_trade(_WT)))
_MO = _MULTI["overlap"]
register("matrix_pivot", lambda spark, d: shape.partner_pivot(
    _on(multi.partner_matrix, _MO)(spark, d), "balance", list(_MO.partners)),
    lambda: oracle_ops.partner_pivot(oracle.partner_matrix(_MO, list(_MO.partners)), "balance",
                                     list(_MO.partners)))
_MCUR = _MULTI["current"]
register("matrix_balance", lambda spark, d: shape.partner_pivot(
    _on(multi.partner_matrix, _MCUR)(spark, d), "balance", list(_MCUR.partners)),
    lambda: oracle_ops.partner_pivot(oracle.partner_matrix(_MCUR, list(_MCUR.partners)), "balance",
                                     list(_MCUR.partners)))
register("table_limits", lambda spark, d: shape.table_limits(shape.partner_pivot(
    _on(multi.partner_matrix, _MO)(spark, d), "balance", list(_MO.partners))),
    lambda: oracle_ops.table_limits(oracle_ops.partner_pivot(
        oracle.partner_matrix(_MO, list(_MO.partners)), "balance", list(_MO.partners)), list(_MO.partners)))
register("table_single", lambda spark, d: shape.table_single(_on(multi.partner_matrix, _SINGLE)(spark, d)),
         lambda: oracle_ops.table_single(oracle.partner_matrix(_SINGLE, list(_SINGLE.partners))))
register("value_labels", lambda spark, d: _on(single.top_partners, _RANK_P)(spark, d).select(
    "partner", "value", rounded_value("value").alias("shown"), value_label("value").alias("label")),
    lambda: oracle_ops.value_labels(oracle.top_partners(_RANK_P)))
_UL = Params("AFRICA", YEARS, unit="gbp", flow="imports")
register("unit_labels", lambda spark, d: _on(single.top_partners, _UL)(spark, d).select(
    "partner", unit_text(F.lit("gbp"), long=False, value=value_label("value")).alias("caption")),
    lambda: oracle_ops.unit_labels(oracle.top_partners(_UL), "gbp"))


def _report(fn, p, part):
    """One result of a report, over its persisted slice; equal slices of a session are kept once."""
    return lambda spark, d: fn(fixture_catalog(spark, d), p)[part]


_RS = _Q3["world_trade_gdp"][0]
register("single_report_world_trade", _report(single.single_report, _RS, "world_trade"), lambda: oracle.world_trade(_RS))
register("single_report_partners", _report(single.single_report, _RS, "partners"), lambda: oracle.top_partners(_RS))
register("single_report_categories", _report(single.single_report, _RS, "categories"), lambda: oracle.top_categories(_RS))
_RM = _MULTI["group_reporter"]
register("multi_report_plot", _report(multi.multi_report, _RM, "plot"), lambda: oracle.partner_series(_RM, list(_RM.partners)))
register("multi_report_table", _report(multi.multi_report, _RM, "table"), lambda: oracle.partner_matrix(_RM, list(_RM.partners)))


def _tiny(spark, d):
    """Flows whose shares of GDP are far below the shown precision: divided by a million, as in small places' trade."""
    cat = fixture_catalog(spark, d)
    scaled = cat.gdp.withColumn("gdp_constant", F.col("gdp_constant") * F.lit(1048576.0))
    top = single.top_partners(replace(cat, gdp=scaled), _TINY)
    return top.withColumn("label", value_label("value"))


_TINY = Params("NATION_9", YEARS, unit="gdp", flow="exports")
register("top_partners_tiny_share", _tiny, lambda: oracle_ops.tiny_share(oracle.top_partners(_TINY), 1048576))


# ---- the same through files: CSV and JSON inputs, serving tables, queries -------------
_FP = Params("EUROPE", YEARS, unit="usd", flow="exports")


def _built(spark, d):
    return jobs.load_catalog(spark, f"{fixture_file_build(spark, d)}/out")


register("files_flows", lambda spark, d: _built(spark, d).flows.select("year", "exporter", "importer", "category", "value"), oracle_ops.files_flows)
register("files_dimensions", lambda spark, d: spark.read.json(
    f"{jobs.serving_root(spark, fixture_file_build(spark, d) + '/out')}/dims/group_membership").select(
    "group_name", F.array_join("members", ", ").alias("members"), F.col("n_members").cast("int").alias("n_members")), oracle_ops.files_dimensions)
register("files_top_partners", lambda spark, d: single.top_partners(_built(spark, d), _FP), lambda: oracle_ops.files_top_partners(_FP))
register("mojibake_names", lambda spark, d: files.read_country_codes(spark, f"{fixture_file_build(spark, d)}/in/codes").select(
    F.col("country_code").alias("code"), F.col("country_name").alias("damaged"), fix_mojibake("country_name").alias("name")), oracle_ops.mojibake_names)


# ---- layout, deliveries, rejects ------------------------------------------------------
register("flows_clustered", lambda spark, d: fixture_catalog(spark, d).flows.select("year", "exporter", "importer", "category", "value"),
         oracle_ops.etl_flows_long)
register("flows_refreshed", lambda spark, d: refresh.load_flows(spark, f"{fixture_refreshed(spark, d)}/out"), oracle_ops.files_flows)
register("flow_files", lambda spark, d: refresh.manifest(spark, f"{fixture_refreshed(spark, d)}/out").select(F.explode("years").alias("year")).distinct(),
         oracle_ops.raw_years)


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/corridor/{what}-{uuid.uuid4().hex}"


def _rejects(spark, d) -> rejects.Build:
    s = fixture_sources(spark, d)
    return rejects.write_audited(s["raw"], s["sections"], s["country_codes"], s["countries"], _folder(spark, "audited"))


register("etl_rejects", lambda spark, d: _rejects(spark, d).rejects, oracle_ops.etl_rejects)
register("etl_accounting", lambda spark, d: rejects.accounting(_rejects(spark, d)), oracle_ops.etl_audit)
register("etl_audited_flows", lambda spark, d: _rejects(spark, d).flows, oracle_ops.etl_flows_long)

# ---- the single-country report from one pass --------------------------------------------
_SETS = {
    "": Params("EUROPE", YEARS, unit="gdp", flow="imports"),
    "_group": Params("BLOC_A", (1996, 2000), unit="eur", prices="constant", flow="exports", group="ASIA", category="S03"),
    "_gaps": Params("NATION_0", YEARS, unit="usd", category="S19"),
}
for _n, _p in _SETS.items():
    register(f"single_report_sets{_n}", _q(sets.single_report_sets, _p), lambda p=_p: oracle_ops.single_report_sets(p))

# ---- names within a few edits, names damaged more than once, wording ------------------------
register("name_resolution_near", lambda spark, d: names.resolve_near(
    fixture.entity_names(spark, d), "entity_name", fixture.aliases(spark, d), k=2), lambda: oracle_ops.name_resolution_near(2))
register("mojibake_repeated", lambda spark, d: fixture.damaged_names(spark, d).select(
    "key", "name", fix_mojibake_repeated("damaged").alias("repaired")), oracle_ops.mojibake_repeated)
register("label_wording", lambda spark, d: membership.build_membership(fixture.countries(spark, d)).select("group_name").distinct().select(
    "group_name", label("group_name", genitive=True).alias("genitive"), label(F.concat("group_name", F.lit(" countries")), verb="exports").alias("plural"),
    label("group_name", verb="exports").alias("singular"), label(F.concat("group_name", F.lit(" balance")), in_sentence=True).alias("sentence")),
    oracle_ops.label_wording)


# ---- the queries as SQL table functions over the named tables -------------------------------
def _sql(text: str):
    def run(spark, d):
        sql.register(fixture_catalog(spark, d))
        return spark.sql(text)
    return run


_SQ1 = Params("EUROPE", YEARS, unit="eur", prices="constant", flow="imports", group="BLOC_A", category="S11")
_SQ2 = Params("NATION_9", YEARS, unit="gdp", flow="exports")
_SQ3 = Params("AFRICA", YEARS, unit="gdp", category="S03")
_SQ4 = Params("NATION_8", (1996, 2000), unit="gbp", category="S03", partners=("BLOC_A", "BLOC_B", "AFRICA"))
_SQ5 = Params("NATION_9", YEARS, unit="gdp", partners=("ASIA", "NATION_0"))
register("sql_top_partners", _sql("SELECT * FROM top_partners('EUROPE', 1995, 2001, 'eur', 'constant', flow => 'imports', counterparts => 'BLOC_A', section => 'S11')"),
         lambda: oracle.top_partners(_SQ1))
register("sql_top_categories", _sql("SELECT * FROM top_categories('NATION_9', 1995, 2001, unit => 'gdp')"), lambda: oracle.top_categories(_SQ2))
register("sql_world_trade", _sql("SELECT * FROM world_trade('AFRICA', 1995, 2001, 'gdp', section => 'S03')"), lambda: oracle.world_trade(_SQ3))
register("sql_partner_series", _sql("SELECT * FROM partner_series('NATION_8', array('BLOC_A', 'BLOC_B', 'AFRICA'), 1996, 2000, 'gbp', section => 'S03')"),
         lambda: oracle.partner_series(_SQ4, list(_SQ4.partners)))
register("sql_partner_matrix", _sql("SELECT * FROM partner_matrix('NATION_9', array('ASIA', 'NATION_0'), 1995, 2001, 'gdp')"),
         lambda: oracle.partner_matrix(_SQ5, list(_SQ5.partners)))


# ---- inputs and results as files; requests as users type them ---------------------------------
def _file_indicators(spark, d):
    return files.read_indicators(spark, fixture_files.write_indicators(spark, d, _folder(spark, "indicators")), fmt="csv")


def _file_coverage(spark, d):
    cov = coverage.build_coverage(fixture.countries(spark, d), _file_indicators(spark, d), fixture.aliases(spark, d), fixture.BASE_YEAR)
    path = _folder(spark, "coverage")
    write_table(cov.select(*COVERAGE.names), path, "csv")
    return files.read_coverage(spark, path)


register("files_indicators", lambda spark, d: _file_indicators(spark, d).where("value is not null").select("entity_name", "indicator_code", "unit", "year", "value"),
         oracle_ops.files_indicators)
register("files_coverage", lambda spark, d: coverage.coverage_display(_file_coverage(spark, d)), lambda: oracle_ops.coverage_display(fixture.BASE_YEAR))
_EX = Params("ASIA", YEARS, unit="usd", flow="imports")


def _exported(spark, d):
    df = single.top_partners(fixture_catalog(spark, d), _EX)
    path = export_result(df, _folder(spark, "results"), file_name("top_partners", _EX))
    return spark.read.schema(df.schema).option("header", True).csv(path)


register("exported_top_partners", _exported, lambda: oracle.top_partners(_EX))


def _requested(spark, d):
    """A request as typed: years out of range and in the wrong order, partners repeated and unknown."""
    cat = fixture_catalog(spark, d)
    bounds = cat.flows.agg(F.min("year"), F.max("year")).first()
    years = sanitize_years("2050", "1066", tuple(bounds))
    partners = select_partners(["AFRICA", "Atlantis", "BLOC_B", "AFRICA"], cat.groups)
    return multi.partner_series(cat, Params("NATION_8", years, unit="usd", partners=partners))


register("requested_series", _requested, lambda: oracle.partner_series(Params("NATION_8", YEARS, unit="usd", partners=("AFRICA", "BLOC_B")), ["AFRICA", "BLOC_B"]))
register("listed_groups", lambda spark, d: membership.build_membership(fixture.countries(spark, d)).join(
    files.literal_relation(spark, ["EUROPE", "BLOC_B", "NATION_3"], "group_name"), "group_name", "left_semi").select("group_name", "country"),
    oracle_ops.listed_groups)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: e.run for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql() for n, e in REGISTRY.items() if e.sql is not None}
