"""The driver's TPC-H-style tables read as a bilateral flow dataset.

supplier nation -> customer nation is the flow, the order year is the year,
a hash of the part key is the product code and the extended price is the
value. Every dimension is a deterministic expression over ``nation``,
``region`` and a year spine, so the same definitions exist as SQL text for the
DuckDB oracle (``corridor.checks.fixture_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CP1252
from ..schemas import VALUE_TYPE
from ..sinks.files import file_states

# Fixed values of the fixture configuration.
BASE_YEAR = 2001                   # base year of constant prices
COVERED_BELOW = 22                 # nations 0..21 are covered, 22..24 are not
BLOC_A_BELOW = 7                   # BLOC_A = nations 0..6
BLOC_B_MODULUS = 3                 # BLOC_B = nations divisible by 3

# Product sections as chapter ranges (lo, hi, section), chapters 00, 98, 99 unmapped.
SECTION_RANGES = (
    (1, 5, "S01"), (6, 14, "S02"), (15, 15, "S03"), (16, 24, "S04"), (25, 27, "S05"),
    (28, 38, "S06"), (39, 40, "S07"), (41, 43, "S08"), (44, 46, "S09"), (47, 49, "S10"),
    (50, 63, "S11"), (64, 67, "S12"), (68, 70, "S13"), (71, 71, "S14"), (72, 83, "S15"),
    (84, 85, "S16"), (86, 89, "S17"), (90, 92, "S18"), (93, 93, "S19"), (94, 96, "S20"),
    (97, 97, "S21"),
)


_tables: dict[tuple[str, ...], DataFrame] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One read handle per state of a table and session: footers are read once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, *file_states(spark, path))
    if key not in _tables:
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 from the order lines: (t, i, j, k, v), v in thousand USD.

    Orders meet customers first (an orders-sized join), so the line items are
    shuffled only for the order join and the supplier join; at small scale the
    planner broadcasts the smaller sides instead.
    """
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", F.year("o_orderdate").cast("int").alias("t"), "c_nationkey")
    return (
        li.join(oc, li.l_orderkey == oc.o_orderkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .select(
            "t",
            F.col("s_nationkey").alias("i"),
            F.col("c_nationkey").alias("j"),
            F.lpad(((F.col("l_partkey") * 7919) % 1000000).cast("string"), 6, "0").alias("k"),
            F.col("l_extendedprice").cast(VALUE_TYPE).alias("v"),
        )
    )


def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with a code, a display name and ISO-like codes."""
    n = _read(spark, sf_dir, "nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return n.select(
        F.col("n_nationkey").alias("country_code"),
        F.col("n_name").alias("country_name"),
        F.concat(F.lit("N"), F.substring(code, 2, 1)).alias("country_iso2"),
        F.concat(F.lit("X"), code).alias("country_iso3"),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered country -> its groups (region, BLOC_A, BLOC_B)."""
    n = _read(spark, sf_dir, "nation").where(F.col("n_nationkey") < COVERED_BELOW)
    r = _read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    groups = F.array(
        F.col("r_name"),
        F.when(key < BLOC_A_BELOW, F.lit("BLOC_A")),
        F.when(key % BLOC_B_MODULUS == 0, F.lit("BLOC_B")),
    )
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_name").alias("country"),
        F.filter(groups, lambda g: g.isNotNull()).alias("groups"),
    )


def sections(spark: SparkSession) -> DataFrame:
    """D3 as (section, chapters[]) built from the range rule, as a literal VALUES relation."""
    rows = ", ".join(
        f"('{sec}', array({', '.join(repr(f'{c:02d}') for c in range(lo, hi + 1))}))"
        for lo, hi, sec in SECTION_RANGES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS sections(category, chapters)")


def time_range(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year of the orders; read once per state of the table and session."""
    key = (spark.sparkContext.applicationId, *file_states(spark, f"{sf_dir.rstrip('/')}/orders.parquet"))
    if key not in _ranges:
        r = _read(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
        _ranges[key] = (r[0], r[1])
    return _ranges[key]


_ranges: dict[tuple[str, ...], tuple[int, int]] = {}


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y0, y1 = time_range(spark, sf_dir)
    return spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("year"))


def observed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years present in the orders (the data's own range)."""
    return _read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("int").alias("year")).distinct()


def _nation_years(spark: SparkSession, sf_dir: str, covered_only: bool = True) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    if covered_only:
        n = n.where(F.col("n_nationkey") < COVERED_BELOW)
    # nation x year scaffold (S11): each nation row expands to its years
    y0, y1 = time_range(spark, sf_dir)
    return n.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year"))


def scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, country) for every covered country and configured year."""
    return _nation_years(spark, sf_dir).select("year", F.col("n_name").alias("country"))


def _dec(expr: str) -> Column:
    return F.expr(f"CAST({expr} AS DECIMAL(10,4))")


def fx(spark: SparkSession, y: DataFrame) -> DataFrame:
    """Currency units per US dollar by year (current prices), for the given years."""
    rate = {
        "usd": "1.0000",
        "cad": "1.2000 + 0.0200 * (year - 1995)",
        "eur": "0.8000 + 0.0100 * (year - 1995)",
        "gbp": "0.6000 + 0.0050 * (year - 1995)",
    }
    parts = [y.select(F.lit(cur).alias("currency"), "year", _dec(e).alias("per_usd")) for cur, e in rate.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constant_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 fixture: one row per (year, country); one row missing, one eur null."""
    ny = _nation_years(spark, sf_dir)
    n, y = F.col("n_nationkey"), F.col("year")
    f = "(1 + 0.0200 * (2001 - year) + 0.0010 * n_nationkey)"
    return ny.where(~((n == 5) & (y == 1997))).select(
        "year",
        F.col("n_name").alias("country"),
        _dec(f).alias("usd_constant"),
        _dec(f"{f} * 1.3").alias("cad_constant"),
        F.when((n % 7 == 3) & (y == 1996), F.lit(None)).otherwise(_dec(f"{f} * 0.9")).alias("eur_constant"),
        _dec(f"{f} * 0.7").alias("gbp_constant"),
    )


def gdp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 fixture: constant-price GDP in millions; one value null."""
    ny = _nation_years(spark, sf_dir)
    n, y = F.col("n_nationkey"), F.col("year")
    gdp = (F.lit(100000.0) * (n + 1) + F.lit(500.0) * (y - 1995)).cast("double")
    return ny.select(
        "year",
        F.col("n_name").alias("country"),
        F.when((n == 9) & (y == 1998), F.lit(None).cast("double")).otherwise(gdp).alias("gdp_constant"),
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 fixture: NGDPD (billion USD) and LP (population) for all nations, plus World.

    Entity names are spelled differently from the country names ("Nation_3")
    so that name resolution has work to do.
    """
    ny = _nation_years(spark, sf_dir, covered_only=False)
    n, y = F.col("n_nationkey"), F.col("year")
    entity = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 1 << 20)))
    gdp_bn = F.when((n == 9) & (y == 1998), F.lit(None).cast("double")).otherwise(
        (F.lit(100000.0) * (n + 1) + F.lit(500.0) * (y - 1995)) / F.lit(1000.0)
    )
    ngdpd = ny.select(entity.alias("entity_name"), F.lit("NGDPD").alias("indicator_code"),
                      F.lit("U.S. dollars").alias("unit"), "year", gdp_bn.alias("value"))
    lp = ny.select(entity.alias("entity_name"), F.lit("LP").alias("indicator_code"),
                   F.lit("Persons").alias("unit"), "year", (F.lit(10.0) * (n + 1)).alias("value"))
    world = ngdpd.groupBy("year").agg(F.sum("value").alias("value")).select(
        F.lit("World").alias("entity_name"), F.lit("NGDPD").alias("indicator_code"),
        F.lit("U.S. dollars").alias("unit"), "year", "value")
    return ngdpd.unionByName(lp).unionByName(world)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name -> ISO3 alias dimension: the display name and the ISO3 code itself."""
    cc = country_codes(spark, sf_dir)
    by_name = cc.select(F.col("country_name").alias("alias"), F.col("country_iso3").alias("iso3"))
    by_code = cc.select(F.col("country_iso3").alias("alias"), F.col("country_iso3").alias("iso3"))
    return by_name.unionByName(by_code)


def deflators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-country GDP deflator and local currency per USD; one deflator missing."""
    ny = _nation_years(spark, sf_dir, covered_only=False)
    n, y = F.col("n_nationkey"), F.col("year")
    defl = F.lit(1.0) - F.lit(0.015) * (F.lit(2001) - y) + F.lit(0.002) * (n % 5)
    lcu = F.lit(1.0) + F.lit(0.5) * n + F.lit(0.01) * (y - 1995)
    return ny.select(
        F.col("n_name").alias("country"),
        "year",
        F.when((n == 4) & (y == 1999), F.lit(None).cast("double")).otherwise(defl).alias("deflator"),
        lcu.alias("lcu_per_usd"),
    )


#: Ways in which ``entity_names`` spells a nation's name.
SPELLINGS = 8


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_name) a customer: the name of the customer's nation, spelled in one of several ways.

    As it is, in lower case with spaces around it, with a sign too many, one left out, one wrong, two
    changed, cut to two signs, or none.
    """
    n, c = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    name, way = F.col("n_name"), F.col("c_custkey") % SPELLINGS
    spelled = [name, F.concat(F.lit("  "), F.lower(name), F.lit(" ")), F.concat(name, F.lit("x")), F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1 << 20)),
               F.concat(F.substring(name, 1, 3), F.lit("q"), F.substring(name, 5, 1 << 20)), F.concat(F.lit("zz"), F.substring(name, 3, 1 << 20)), F.substring(name, -2, 2)]
    out = F.lit(None).cast("string")
    for i, s in enumerate(spelled):
        out = F.when(way == i, s).otherwise(out)
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(out.alias("entity_name"))


def damaged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, damaged) of every nation: an accented name, its bytes read wrongly up to three times."""
    n = _read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    name = F.concat("n_name", F.element_at(F.array(*map(F.lit, ("é", "", " d’Or", "ü ç"))), (key % 4 + 1).cast("int")))
    damaged = name
    for k in (1, 2, 3):
        wrong = F.decode(F.encode(damaged, "UTF-8"), "ISO-8859-1")
        wrong = F.translate(wrong, "".join(CP1252.values()), "".join(CP1252)) if k == 2 else wrong  # the second time as Windows-1252
        damaged = F.when(key % 5 >= k, wrong).otherwise(damaged)
    return n.select(key.alias("key"), name.alias("name"), damaged.alias("damaged"))
