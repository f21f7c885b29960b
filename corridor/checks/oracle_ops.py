"""Oracle SQL for the ETL, dimension, builder, audit and shaping operators."""

from __future__ import annotations

from ..sources.fixture import BASE_YEAR, SECTION_RANGES
from .fixture_sql import with_fixture
from . import oracle
from .oracle import q

CATEGORIES = sorted(sec for _, _, sec in SECTION_RANGES)


def over(base_sql: str, body: str) -> str:
    """Shape a query result: ``WITH base AS (<query>) <body>``."""
    return f"WITH base AS ({base_sql})\n{body}"


def etl_flows_long() -> str:
    return with_fixture("SELECT year, exporter, importer, category, value FROM flows")


def etl_flows_wide() -> str:
    cols = ",\n".join(f"MAX(CASE WHEN category = {q(c)} THEN CAST(value AS DECIMAL(18,2)) END) AS {c}"
                      for c in CATEGORIES)
    return with_fixture(f"SELECT CAST(year AS SMALLINT) AS year, exporter, importer,\n{cols}\n"
                        "FROM flows GROUP BY year, exporter, importer")


def etl_wide_to_long() -> str:
    return with_fixture("SELECT year, exporter, importer, category, CAST(value AS DECIMAL(18,2)) AS value FROM flows")


def etl_audit() -> str:
    return with_fixture("""
        SELECT CAST(COUNT(*) AS BIGINT) AS rows_in,
               CAST(SUM(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS rows_kept,
               CAST(SUM(CASE WHEN unmapped THEN 1 ELSE 0 END) AS BIGINT) AS rows_unmapped,
               CAST(SUM(CASE WHEN NOT unmapped AND NOT exp_ok THEN 1 ELSE 0 END) AS BIGINT) AS rows_bad_exporter,
               CAST(SUM(CASE WHEN NOT unmapped AND exp_ok AND NOT imp_ok THEN 1 ELSE 0 END) AS BIGINT)
                   AS rows_bad_importer,
               CAST(COALESCE(SUM(v), 0) AS DECIMAL(38,2)) AS value_in,
               CAST(COALESCE(SUM(CASE WHEN kept THEN v END), 0) AS DECIMAL(38,2)) AS value_kept,
               CAST(COALESCE(SUM(CASE WHEN NOT kept THEN v END), 0) AS DECIMAL(38,2)) AS value_rejected
        FROM (SELECT r.v,
                     substr(r.k, 1, 2) NOT IN (SELECT chapter FROM sections) AS unmapped,
                     r.i IN (SELECT code FROM covered) AS exp_ok,
                     r.j IN (SELECT code FROM covered) AS imp_ok,
                     substr(r.k, 1, 2) IN (SELECT chapter FROM sections)
                       AND r.i IN (SELECT code FROM covered) AND r.j IN (SELECT code FROM covered) AS kept
              FROM raw_flows r)""")


def dim_sections() -> str:
    return with_fixture("""
        SELECT DISTINCT s.chapter, s.category FROM raw_flows r JOIN sections s ON substr(r.k, 1, 2) = s.chapter""")


def section_coverage() -> str:
    return with_fixture("""
        SELECT substr(r.k, 1, 2) AS chapter, s.category, COUNT(*) AS n_lines
        FROM raw_flows r LEFT JOIN sections s ON substr(r.k, 1, 2) = s.chapter
        GROUP BY substr(r.k, 1, 2), s.category""")


def dim_countries() -> str:
    return with_fixture("SELECT code, country AS name FROM covered")


def dim_membership() -> str:
    return with_fixture("SELECT group_name, country FROM membership")


def dim_group_members() -> str:
    return with_fixture("""
        SELECT group_name, string_agg(country, ', ' ORDER BY country) AS members,
               CAST(COUNT(DISTINCT country) AS INTEGER) AS n_members
        FROM membership GROUP BY group_name""")


def group_catalogue() -> str:
    return with_fixture("""
        SELECT group_name, CAST(COUNT(DISTINCT country) AS INTEGER) AS n_members,
               string_agg(country, ', ' ORDER BY country) AS members
        FROM membership GROUP BY group_name HAVING COUNT(DISTINCT country) > 1""")


def dim_true_groups() -> str:
    return with_fixture("""
        SELECT group_name, CAST(COUNT(DISTINCT country) AS INTEGER) AS n_members
        FROM membership GROUP BY group_name HAVING COUNT(DISTINCT country) > 1""")


def slugs() -> str:
    return with_fixture(r"""
        SELECT group_name, regexp_replace(lower(group_name), '\s+', '_', 'g') AS slug,
               regexp_replace(lower(upper(substr(g2, 1, 1)) || substr(g2, 2)), '\s+', '_', 'g') AS file_label
        FROM (SELECT DISTINCT group_name,
                     regexp_replace(group_name, '^(.*?)balance', '\1trade balance') AS g2 FROM membership)""")


def gdp_table() -> str:
    return with_fixture("SELECT year, country, gdp_constant FROM gdp_table")


def valid_counterparts(reporter: str) -> str:
    return with_fixture(f"""
        SELECT DISTINCT group_name FROM membership
        WHERE group_name NOT IN (
            SELECT group_name FROM membership
            WHERE country IN (SELECT country FROM membership WHERE group_name = {q(reporter)}))""")


def random_counterparts(reporter: str, n: int, seed: int) -> str:
    return over(valid_counterparts(reporter), f"SELECT group_name FROM base ORDER BY md5('{seed}|' || group_name), group_name LIMIT {n}")


def name_resolution_audit() -> str:
    return with_fixture("""
        SELECT n.entity_name AS name, a.iso3, n.n_rows, a.iso3 IS NOT NULL AS matched
        FROM (SELECT entity_name, COUNT(*) AS n_rows FROM indicators GROUP BY entity_name) n
        LEFT JOIN al a ON lower(trim(n.entity_name)) = a.al""")


def rest_of_sample(group: str) -> str:
    return with_fixture(f"""
        SELECT DISTINCT country FROM membership
        WHERE country NOT IN (SELECT country FROM membership WHERE group_name = {q(group)})""")


def factor_current() -> str:
    return with_fixture("""
        SELECT c.year, c.usd_current, c.cad_current, c.eur_current, c.gbp_current
        FROM current_conversion c
        WHERE c.year IN (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) FROM orders)""")


def factor_constant() -> str:
    b = BASE_YEAR
    rates = ", ".join(
        f"uf * (SELECT MAX(CAST(per_usd AS DOUBLE)) FROM fx WHERE year = {b} AND currency = {q(c)}) AS {c}_constant"
        for c in ("usd", "cad", "eur", "gbp"))
    return with_fixture(f"""
        SELECT year, country, usd_constant, cad_constant, eur_constant, gbp_constant FROM (
          SELECT year, country, {rates} FROM (
            SELECT s.year, s.country,
                   CAST(d.lcu_per_usd AS DOUBLE) / (CAST(d.deflator AS DOUBLE) / CAST(b.deflator AS DOUBLE))
                     / CAST(b.lcu_per_usd AS DOUBLE) AS uf
            FROM scaffold s
            LEFT JOIN deflators d ON s.country = d.country AND s.year = d.year
            LEFT JOIN (SELECT * FROM deflators WHERE year = {b}) b ON s.country = b.country))
        WHERE 2 + (usd_constant IS NOT NULL)::INT + (cad_constant IS NOT NULL)::INT
                + (eur_constant IS NOT NULL)::INT + (gbp_constant IS NOT NULL)::INT >= 4""")


def gdp_build(base_country: str) -> str:
    return with_fixture(f"""
        SELECT sc.year, sc.country, g.gdp_current / dd.d AS gdp_constant
        FROM (SELECT s.year, s.country, a.iso3 FROM scaffold s LEFT JOIN al a ON lower(trim(s.country)) = a.al) sc
        LEFT JOIN (SELECT i.year, a.iso3, i.value * 1000.0::DOUBLE AS gdp_current
                   FROM indicators i JOIN al a ON lower(trim(i.entity_name)) = a.al
                   WHERE i.indicator_code = 'NGDPD' AND i.unit = 'U.S. dollars') g
               ON sc.iso3 = g.iso3 AND sc.year = g.year
        LEFT JOIN (SELECT year, deflator / (SELECT MAX(deflator) FROM deflators
                                            WHERE country = {q(base_country)} AND year = {BASE_YEAR}) AS d
                   FROM deflators WHERE country = {q(base_country)}) dd
               ON sc.year = dd.year""")


def coverage(year: int) -> str:
    return with_fixture(f"""
        SELECT CAST((SELECT COUNT(*) FROM covered) AS INTEGER) AS n_countries,
               SUM(CASE WHEN indicator_code = 'NGDPD' AND unit = 'U.S. dollars' AND inside THEN value END)
                 / SUM(CASE WHEN indicator_code = 'NGDPD' AND unit = 'U.S. dollars' AND entity_name = 'World'
                            THEN value END) * 100.0::DOUBLE AS gdp_share,
               SUM(CASE WHEN indicator_code = 'LP' AND inside THEN value END)
                 / SUM(CASE WHEN indicator_code = 'LP' THEN value END) * 100.0::DOUBLE AS pop_share
        FROM (SELECT i.*, a.iso3 IN (SELECT a2.iso3 FROM covered c JOIN al a2 ON lower(trim(c.country)) = a2.al)
                          AND a.iso3 IS NOT NULL AS inside
              FROM indicators i LEFT JOIN al a ON lower(trim(i.entity_name)) = a.al
              WHERE i.year = {year})""")


def coverage_display(year: int) -> str:
    return over(coverage(year), "SELECT n_countries, ROUND(gdp_share, 1) AS gdp_share, ROUND(pop_share, 1) AS pop_share "
                                "FROM base")


def sample_note(year: int, reporter: str) -> str:
    return over(coverage(year), f"""
        SELECT {q(reporter)} AS country,
               CAST(n_countries - (SELECT COUNT(*) FROM ({dim_membership()}) m WHERE m.group_name = {q(reporter)})
                    AS INTEGER) AS n_partners,
               ROUND(gdp_share, 1) AS gdp_share, ROUND(pop_share, 1) AS pop_share
        FROM base""")


def missing_factors(reporter: str, years: tuple[int, int]) -> str:
    m = f"(SELECT country FROM membership WHERE group_name = {q(reporter)})"
    y0, y1 = years
    return with_fixture(f"""
        SELECT year, reporter FROM (
          SELECT year, exporter AS reporter FROM flows WHERE exporter IN {m} AND year BETWEEN {y0} AND {y1}
          UNION SELECT year, importer FROM flows WHERE importer IN {m} AND year BETWEEN {y0} AND {y1})
        EXCEPT SELECT year, country FROM constant_conversion""")


# ---- shaping over a query result -------------------------------------------

def rank_table(base_sql: str, flow: str, key: str, k: int | None = None) -> str:
    order = f"value DESC NULLS LAST, {key}" if flow == "exports" else f"value ASC NULLS LAST, {key}"
    lim = f" WHERE rank <= {k}" if k is not None else ""
    return over(base_sql, f"""
        SELECT * FROM (SELECT {key}, value AS {flow}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
                       FROM base WHERE flow = {q(flow)}){lim}""")


def table_single(base_sql: str) -> str:
    return over(base_sql, "SELECT category, imports, exports, balance FROM base ORDER BY exports DESC NULLS LAST")


def series_long(base_sql: str) -> str:
    return over(base_sql, """
        SELECT year, make_date(year, 1, 1) AS date, partner, flow, value
        FROM (UNPIVOT (SELECT year, partner, imports, exports, balance FROM base)
              ON imports, exports, balance INTO NAME flow VALUE value)""")


def series_one_flow(base_sql: str, flow: str) -> str:
    return over(series_long(base_sql), f"SELECT * FROM base WHERE flow = {q(flow)} AND value <> 0")


def series_flags(base_sql: str) -> str:
    w = "PARTITION BY partner ORDER BY year ASC NULLS LAST"
    return over(base_sql, f"""
        SELECT partner, bool_or(gap) AS has_break, COUNT(v) = 1 AS single_value FROM (
          SELECT partner, balance AS v,
                 balance IS NULL
                 AND MAX(CASE WHEN balance IS NOT NULL THEN 1 END)
                     OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL
                 AND MAX(CASE WHEN balance IS NOT NULL THEN 1 END)
                     OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) IS NOT NULL AS gap
          FROM base)
        GROUP BY partner""")


def partner_pivot(base_sql: str, flow: str, partners, key: str = "category") -> str:
    cols = ", ".join(f'MAX(CASE WHEN partner = {q(p)} THEN {flow} END) AS "{p}"' for p in partners)
    return over(base_sql, f"SELECT {key}, {cols} FROM base GROUP BY {key} ORDER BY {key}")


def table_limits(base_sql: str, columns) -> str:
    mins = ", ".join(f'MIN(CAST("{c}" AS DOUBLE))' for c in columns)
    maxs = ", ".join(f'MAX(CAST("{c}" AS DOUBLE))' for c in columns)
    return over(base_sql, f"SELECT LEAST({mins}) AS min_value, GREATEST({maxs}) AS max_value FROM base")


def bar_share(base_sql: str, column: str) -> str:
    lo = f"(SELECT MIN(CAST({column} AS DOUBLE)) FROM base)"
    hi = f"(SELECT MAX(CAST({column} AS DOUBLE)) FROM base)"
    rng = f"NULLIF(ABS({hi}) + ABS({lo}), 0)"
    return over(base_sql, f"""
        SELECT *, LEAST(100.0::DOUBLE, 100.0::DOUBLE * ABS({column}) / {rng}) AS bar_width,
               ABS({lo}) / {rng} AS zero_position
        FROM base""")


def _label(c: str) -> str:
    r = f"ROUND(CAST({c} AS DECIMAL(38,6)), 2)"
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 THEN '0' "
            f"WHEN {c} > 0 AND {c} < 0.01 THEN '< 0.01' "
            f"WHEN {c} < 0 AND {c} > -0.01 THEN '> -0.01' "
            rf"ELSE regexp_replace(format('{{:,.2f}}', {r}), '(\.\d)0$', '\1') END")


def value_labels(base_sql: str) -> str:
    return over(base_sql, f"""
        SELECT partner, value, COALESCE(CAST(ROUND(CAST(value AS DECIMAL(38,6)), 2) AS DOUBLE), 0.0) AS shown,
               {_label('value')} AS label
        FROM base""")


def unit_labels(base_sql: str, unit: str) -> str:
    prefix = {"usd": "US$", "eur": "€", "cad": "CA$", "gbp": "£"}.get(unit, "")
    suffix = "% of GDP" if unit == "gdp" else "M"
    return over(base_sql, f"""
        SELECT partner, {q(prefix if unit != 'gdp' else '')} || {_label('value')} || ' ' || {q(suffix)} AS caption
        FROM base""")


def tiny_share(base_sql: str, factor: int) -> str:
    """Shares of a GDP ``factor`` (a power of two, so exactly) as large."""
    return over(base_sql, f"""
        SELECT years, country, partner, flow, value / {factor}.0::DOUBLE AS value, unit, {_label(f'(value / {factor}.0::DOUBLE)')} AS label FROM base""")


# ---- the fixture as input files, where nations divisible by 5 have an accented name ----

_ACCENTED = "n_name || CASE WHEN n_nationkey % 5 = 0 THEN 'é' ELSE '' END"


def _renamed(sql: str) -> str:
    """The statement with the covered names and the groups of the input files."""
    plain = "SELECT n_nationkey AS code, n_name AS country FROM nation WHERE n_nationkey < 22"
    assert plain in sql
    named = sql.replace(plain, f"SELECT n_nationkey AS code, {_ACCENTED} AS country FROM nation WHERE n_nationkey < 22")
    groups = named.index("membership AS (")
    head, tail = named[:groups], named[groups:]
    end = tail.index("years AS (")
    inside = tail[:end].replace("n.n_name", "n.nm").replace("n_name", "nm").replace("nation n", f"(SELECT *, {_ACCENTED} AS nm FROM nation) n")
    inside = inside.replace("FROM nation WHERE", f"FROM (SELECT *, {_ACCENTED} AS nm FROM nation) WHERE")
    return head + inside + tail[end:]


def files_flows() -> str:
    return _renamed(etl_flows_long())


def files_dimensions() -> str:
    return _renamed(dim_group_members())


def files_top_partners(p) -> str:
    return _renamed(oracle.top_partners(p))


def mojibake_names() -> str:
    return f"""SELECT n_nationkey AS code, replace({_ACCENTED}, 'é', 'Ã©') AS damaged, {_ACCENTED} AS name FROM nation"""


def raw_years() -> str:
    return with_fixture("SELECT DISTINCT t AS year FROM raw_flows")


def etl_rejects() -> str:
    return with_fixture("""
        SELECT CASE WHEN chapter NOT IN (SELECT chapter FROM sections) THEN 'unmapped product'
                    WHEN i NOT IN (SELECT code FROM covered) THEN 'uncovered exporter' ELSE 'uncovered importer' END AS reason,
               t AS year, i, j, chapter, COUNT(*) AS n_rows, CAST(SUM(v) AS DECIMAL(28,2)) AS value
        FROM (SELECT *, substr(k, 1, 2) AS chapter FROM raw_flows)
        WHERE chapter NOT IN (SELECT chapter FROM sections) OR i NOT IN (SELECT code FROM covered) OR j NOT IN (SELECT code FROM covered)
        GROUP BY ALL""")


def single_report_sets(p) -> str:
    null = "CAST(NULL AS DOUBLE)"
    return f"""
        SELECT 'partners' AS part, years, country, CAST(NULL AS INTEGER) AS year, partner, {q(p.category)} AS category, flow, value,
               {null} AS imports, {null} AS exports, {null} AS balance, unit FROM ({oracle.top_partners(p)})
        UNION ALL SELECT 'categories', years, country, NULL, partner, category, flow, value, NULL, NULL, NULL, unit FROM ({oracle.top_categories(p)})
        UNION ALL SELECT 'world_trade', {q(p.years_label)}, country, year, partner, category, NULL, NULL, imports, exports, balance, unit
        FROM ({oracle.world_trade(p)})"""


def name_resolution_near(k: int) -> str:
    """Every name against every alias."""
    return with_fixture(f"""
        SELECT name, n_rows, CASE WHEN n_codes = 1 THEN candidates END AS iso3, CAST(distance AS INTEGER) AS distance, candidates,
               CASE WHEN n_codes IS NULL THEN 'none' WHEN n_codes > 1 THEN 'ambiguous' WHEN distance = 0 THEN 'exact' ELSE 'near' END AS status
        FROM (SELECT entity_name AS name, COUNT(*) AS n_rows FROM spelled GROUP BY entity_name) n
        LEFT JOIN (SELECT name AS hit, distance, string_agg(iso3, ',' ORDER BY iso3) AS candidates, COUNT(*) AS n_codes
                   FROM (SELECT DISTINCT name, iso3, distance FROM compared WHERE distance = (SELECT MIN(distance) FROM compared o WHERE o.name = compared.name))
                   GROUP BY name, distance) b ON n.name = b.hit""", {
        "spelled": """
        SELECT CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) || ' ' WHEN 2 THEN n_name || 'x'
                    WHEN 3 THEN substr(n_name, 1, 2) || substr(n_name, 4) WHEN 4 THEN substr(n_name, 1, 3) || 'q' || substr(n_name, 5)
                    WHEN 5 THEN 'zz' || substr(n_name, 3) WHEN 6 THEN right(n_name, 2) END AS entity_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "compared": f"""
        SELECT e.name, a.iso3, levenshtein(lower(trim(e.name)), a.al) AS distance
        FROM (SELECT DISTINCT entity_name AS name FROM spelled) e, al a WHERE levenshtein(lower(trim(e.name)), a.al) <= {k}""",
    })


_DAMAGED = "n_name || CASE n_nationkey % 4 WHEN 0 THEN 'é' WHEN 1 THEN '' WHEN 2 THEN ' d’Or' ELSE 'ü ç' END"


def mojibake_repeated() -> str:
    return f"SELECT n_nationkey AS key, {_DAMAGED} AS name, {_DAMAGED} AS repaired FROM nation"


def label_wording() -> str:
    def cap(x: str) -> str:
        return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"

    balance = "group_name || ' trade balance with'"
    return with_fixture(f"""
        SELECT group_name, {cap('group_name')} || CASE WHEN suffix(group_name, 's') THEN '''' ELSE '''s' END AS genitive,
               {cap("group_name || ' countries'")} || ' export' AS plural, {cap('group_name')} || ' exports' AS singular, {cap(balance)} AS sentence
        FROM (SELECT DISTINCT group_name FROM membership)""")


def files_indicators() -> str:
    return with_fixture("SELECT entity_name, indicator_code, unit, year, value FROM indicators WHERE value IS NOT NULL")


def listed_groups() -> str:
    return with_fixture("SELECT group_name, country FROM membership WHERE group_name IN ('EUROPE', 'BLOC_B', 'NATION_3')")
