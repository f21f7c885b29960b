"""Names within a few edits, SQL table functions, the report from one pass, unique dimension keys, text repair."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corridor.functions.text import fix_mojibake_repeated, label
from corridor.operators import convert, names
from corridor.operators.joins import unique
from corridor.operators.normalize import build_flows
from corridor.params import Params
from corridor.plans import multi, sets, single, sql
from corridor.registry import queries
from corridor.sources import files

from .conftest import D
from .test_plans import final_plan

YEARS = (1995, 2001)


# ---- near names ------------------------------------------------------------------------

def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_all_pairs_within_k_edits_are_found(spark, k):
    """Short strings, repeated grams and few letters, where rare tokens are hardest to come by."""
    rnd = random.Random(k)

    def word(letters, longest):
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest)))

    a = {word("ab", 6) for _ in range(60)} | {word("abcdefgh é", 14) for _ in range(150)} | {"", "aaaaaaaaaa", "x"}
    b = {word("ab", 7) for _ in range(60)} | {w[:3] + w[4:] for w in a} | {w[:2] + "q" + w[2:] for w in a} | {w[::-1] for w in a}
    got = names.candidates(spark.createDataFrame([(w,) for w in a], "name string"), spark.createDataFrame([(w,) for w in b], "alias string"), k)
    got = {(r.name, r.alias): r.distance for r in got.collect()}
    want = {(x, y): edits(x, y) for x in a for y in b if edits(x, y) <= k}
    assert got == want and len(want) > 300


def test_nearest_code_ambiguous_and_unknown_names(spark):
    aliases = spark.createDataFrame([("Kenya", "KEN"), ("Niger", "NER"), ("Nigeria", "NGA"), ("Congo", "COG"), ("congo ", "COD"), ("Peru", "PER"), (None, "XXX"), ("Void", None)], "alias string, iso3 string")
    df = spark.createDataFrame([("Kenya",), (" KENYA",), ("Kenia",), ("Nigera",), ("Congo",), ("Konga",), ("Atlantis",), (None,), ("Kenia",), ("Void",), ("",)], "n string")
    got = {r.name: tuple(r)[1:] for r in names.resolve_near(df, "n", aliases, 2).collect()}
    assert got == {"Kenya": (1, "KEN", 0, "KEN", "exact"), " KENYA": (1, "KEN", 0, "KEN", "exact"), "Kenia": (2, "KEN", 1, "KEN", "near"),
                   "Nigera": (1, None, 1, "NER,NGA", "ambiguous"), "Congo": (1, None, 0, "COD,COG", "ambiguous"), "Konga": (1, None, 2, "COD,COG,KEN", "ambiguous"),
                   "Atlantis": (1, None, None, None, "none"), None: (1, None, None, None, "none"), "Void": (1, None, None, None, "none"), "": (1, None, None, None, "none")}
    assert names.resolve_near(df.limit(0), "n", aliases).count() == 0


def test_near_names_form_no_pairs_of_all(spark):
    df = spark.createDataFrame([("abc",)], "n string")
    text = names.resolve_near(df, "n", spark.createDataFrame([("abd", "X")], "alias string, iso3 string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def fact_scans(text: str, tree: str) -> int:
    """Scans of the fact in the plan that ran."""
    ids = re.findall(r"Scan parquet\s+\((\d+)\)", tree)
    return sum(bool(re.search(rf"\n\({i}\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: InMemoryFileIndex[^\n]*/flows\]", text)) for i in ids)


# ---- SQL table functions -------------------------------------------------------------------

def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols and dict(a.dtypes) == dict(b.dtypes)
    return sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


@pytest.mark.parametrize(("unit", "prices"), [("usd", "current"), ("cad", "constant"), ("gdp", "current")])
@pytest.mark.parametrize("reporter", ["G2", "nowhere"])
def test_functions_equal_the_queries(spark, micro, unit, prices, reporter):
    sql.register(micro)
    p = Params(reporter, (2002, 2003), unit=unit, prices=prices, partners=("G2", "A"))
    head = f"'{reporter}', 2002, 2003, '{unit}', '{prices}'"
    for flow in ("exports", "imports"):
        for group in ("All countries*", "G1") if flow == "exports" else ("C",):
            one = p.with_(flow=flow, group=group)
            assert same(spark.sql(f"SELECT * FROM top_partners({head}, '{flow}', '{group}')"), single.top_partners(micro, one))
        assert same(spark.sql(f"SELECT * FROM top_categories({head}, flow => '{flow}')"), single.top_categories(micro, p.with_(flow=flow)))
    for section in ("All",) if unit == "usd" else ("X",):
        assert same(spark.sql(f"SELECT * FROM world_trade({head}, section => '{section}')"), single.world_trade(micro, p.with_(category=section)))
        assert same(spark.sql(f"SELECT * FROM partner_series('{reporter}', array('G2', 'A'), 2002, 2003, '{unit}', '{prices}', section => '{section}')"), multi.partner_series(micro, p.with_(category=section)))
    assert same(spark.sql(f"SELECT * FROM partner_matrix('{reporter}', array('G2', 'A'), 2002, 2003, '{unit}', '{prices}')"), multi.partner_matrix(micro, p))


def test_function_bodies_become_part_of_the_plan(spark, sf001):
    sql.register(sf001)
    text, tree = final_plan(spark.sql("SELECT * FROM top_partners('EUROPE', 1996, 1998, flow => 'imports')"))
    assert re.search(r"PartitionFilters: \[[^\n]*year[^\n]*1996", text) and "/constant]" not in text, "years prune partitions, the other factor table is gone"
    assert fact_scans(text, tree) == 1
    assert "NestedLoop" not in tree and "CartesianProduct" not in tree
    joined = spark.sql("SELECT c.category, p.partner FROM top_categories('EUROPE', 1996, 1998) c JOIN top_partners('ASIA', 1996, 1998, section => 'S01') p ON c.unit = p.unit WHERE p.value > 0")
    assert joined.count() > 0


# ---- one pass over grouping sets --------------------------------------------------------------

@pytest.mark.parametrize("p", [Params("G1", (2002, 2003)), Params("A", (2002, 2003), unit="gdp", flow="imports"), Params("G2", (2002, 2003), unit="cad", prices="constant", category="X", group="A"),
                               Params("nowhere", (2002, 2003)), Params("B", (2001, 2004), unit="eur", category="Z", flow="imports")])
def test_report_sets_equal_the_queries(spark, micro, p):
    got = sets.parts(sets.single_report_sets(micro, p))
    assert same(got["partners"], single.top_partners(micro, p)) and same(got["categories"], single.top_categories(micro, p))
    assert same(got["world_trade"], single.world_trade(micro, p))


def test_report_sets_scan_the_fact_once(spark, sf001):
    text, tree = final_plan(sets.single_report_sets(sf001, Params("EUROPE", YEARS)))
    assert fact_scans(text, tree) == 1
    # the partial sums of all sets cross in one shuffle; the other is of what they leave
    sums = re.findall(r"Arguments: hashpartitioning\(([^\n]*)\)", text)
    assert len({s for s in sums if "spark_grouping_id" in s}) == 1 and len(re.findall(r"(?<!Broadcast)Exchange [(]", tree)) <= 2 and "Expand" in tree
    assert re.search(r"(In|EqualTo)\((exporter|importer)", text)


def test_reports_read_their_slice(spark):
    """The registered report rows run over the persisted slice."""
    for name in ("single_report_partners", "multi_report_table"):
        df = queries()[name](spark, "/root/testdata/sf0.01")
        assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString()


# ---- dimension keys -----------------------------------------------------------------------------

def flows_of(spark, sections, codes):
    raw = spark.createDataFrame([(2002, 1, 2, "010000", D("1000.00"), None)], "t int, i int, j int, k string, v decimal(18,2), q string")
    covered = spark.createDataFrame([("A", []), ("B", []), ("A2", [])], "country string, groups array<string>")
    sections = spark.createDataFrame(sections, "category string, chapters array<string>")
    codes = spark.createDataFrame([(c, n, None, None) for c, n in codes], "country_code int, country_name string, country_iso2 string, country_iso3 string")
    return [float(r.value) for r in build_flows(raw, sections, codes, covered).collect()]


def test_repeated_dimension_keys_never_double_trade(spark):
    assert flows_of(spark, [("X", ["01"])], [(1, "A"), (2, "B")]) == [1.0]
    assert flows_of(spark, [("X", ["01", "01"]), ("X", ["01"])], [(1, "A"), (2, "B"), (1, "A")]) == [1.0], "equal rows count once"
    with pytest.raises(Exception, match="names of a code"):
        flows_of(spark, [("X", ["01"])], [(1, "A"), (2, "B"), (1, "A2")])
    with pytest.raises(Exception, match="sections of a chapter"):
        flows_of(spark, [("X", ["01"]), ("Y", ["01"])], [(1, "A"), (2, "B")])


def test_readers_keep_the_last_of_repeated_keys(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("country_code,country_name,country_iso2,country_iso3\n1,Old,O,OLD\n2,B,B,BBB\n1,New,N,NEW\n")
    got = {r.country_code: r.country_name for r in files.read_country_codes(spark, str(tmp_path / "codes.csv")).collect()}
    assert got == {1: "New", 2: "B"}
    (tmp_path / "sections.json").write_text(json.dumps({"X": ["01", "02", "02"], "Y": ["03", "01"], "Z": []}))
    got = {r.category: list(r.chapters) for r in files.read_sections(spark, str(tmp_path / "sections.json")).collect()}
    assert got == {"X": ["02"], "Y": ["03", "01"], "Z": []}
    (tmp_path / "gdp.csv").write_text("year,country,gdp_constant\n2002,A,1\n2002,A,2\n")
    with pytest.raises(Exception, match="gdp table"):
        files.read_factor_table(spark, str(tmp_path / "gdp.csv"), "gdp").collect()


def test_factor_builders_reject_repeated_rows(spark):
    fx = [("usd", 2002, 1.0), ("cad", 2002, 1.5), ("eur", 2002, 0.9), ("gbp", 2002, 0.6)]
    years = spark.createDataFrame([(2002,)], "year int")
    frame = lambda rows: spark.createDataFrame(rows, "currency string, year int, per_usd double")
    assert convert.build_current_factors(frame(fx + fx[:1]), years).first().cad_current == 1.5
    with pytest.raises(Exception, match="exchange rates"):
        convert.build_current_factors(frame([*fx, ("cad", 2002, 1.6)]), years).collect()
    deflators = spark.createDataFrame([("A", 2002, 1.0, 1.0), ("A", 2002, 2.0, 1.0)], "country string, year int, deflator double, lcu_per_usd double")
    with pytest.raises(Exception, match="deflators"):
        convert.build_constant_factors(spark.createDataFrame([(2002, "A")], "year int, country string"), deflators, frame(fx), 2002).collect()
    assert unique(years.union(years), ["year"], "years").count() == 1


# ---- text ---------------------------------------------------------------------------------------

def test_repeated_damage_is_undone_and_sound_text_stays(spark):
    def damaged(text, charsets):
        for c in charsets:
            text = text.encode().decode(c)
        return text

    sound = ["Côte d’Ivoire", "São Tomé", "Türkiye", "Åland", "日本", "Ünïçødé – “x”", "Ã", "â€", "Réunion €5", "plain", "", None]
    rows = [(s, s) for s in sound]
    for s in ("Côte", "Türkiye é", "Curaçao", "x’y", "日本"):
        for charsets in (["latin1"], ["latin1"] * 2, ["latin1"] * 6, ["cp1252"], ["cp1252"] * 2, ["latin1", "cp1252"], ["cp1252", "latin1"]):
            try:
                rows.append((s, damaged(s, charsets)))
            except UnicodeDecodeError:  # a byte that Windows-1252 has no sign for
                pass
    got = spark.createDataFrame(rows, "want string, text string").select("want", fix_mojibake_repeated("text").alias("got")).collect()
    assert len(got) > 35 and all(r.got == r.want for r in got), [r for r in got if r.got != r.want]


def test_genitive_and_verb(spark):
    df = spark.createDataFrame([("Kenya",), ("United States",), ("G20 countries",)], "c string")
    got = [tuple(r) for r in df.select(label("c", genitive=True), label("c", verb="exports"), label("c", verb="trade"), label(F.lit("balance"), genitive=True)).collect()]
    assert got == [("Kenya's", "Kenya exports", "Kenya trade", "Trade balance's"), ("United States'", "United States exports", "United States trade", "Trade balance's"),
                   ("G20 countries'", "G20 countries export", "G20 countries trade", "Trade balance's")]
