"""The fixture dataset as DuckDB SQL, for the oracle side of the correctness check.

Same definitions as ``corridor.sources.fixture`` and the ETL, written
independently as plain SQL over the driver's pre-registered views.
"""

from __future__ import annotations

from ..sources.fixture import SECTION_RANGES

_ranges = ", ".join(f"({lo}, {hi}, '{sec}')" for lo, hi, sec in SECTION_RANGES)

CTES: dict[str, str] = {
    "raw_flows": """
        SELECT CAST(year(o.o_orderdate) AS INTEGER) AS t, s.s_nationkey AS i, c.c_nationkey AS j,
               lpad(CAST((l.l_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS k,
               CAST(l.l_extendedprice AS DECIMAL(18,2)) AS v
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "sections": f"""
        SELECT lpad(CAST(ch AS VARCHAR), 2, '0') AS chapter, category
        FROM (SELECT unnest(range(lo, hi + 1)) AS ch, category
              FROM (VALUES {_ranges}) r(lo, hi, category))""",
    "covered": "SELECT n_nationkey AS code, n_name AS country FROM nation WHERE n_nationkey < 22",
    "flows_sum": """
        SELECT r.t AS year, e.country AS exporter, m.country AS importer, sec.category,
               CAST(SUM(r.v) * 100 AS BIGINT) AS x
        FROM raw_flows r
        JOIN covered e ON r.i = e.code
        JOIN covered m ON r.j = m.code
        JOIN sections sec ON substr(r.k, 1, 2) = sec.chapter
        GROUP BY r.t, e.country, m.country, sec.category""",
    # thousand -> million with half-even rounding, in integer hundredths
    "flows": """
        SELECT year, exporter, importer, category,
               CAST(CAST(x // 1000 + CASE WHEN x % 1000 > 500 OR (x % 1000 = 500 AND (x // 1000) % 2 = 1)
                                         THEN 1 ELSE 0 END AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS value
        FROM flows_sum""",
    "membership": """
        SELECT n_name AS group_name, n_name AS country FROM nation WHERE n_nationkey < 22
        UNION SELECT r.r_name, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
              WHERE n.n_nationkey < 22
        UNION SELECT 'BLOC_A', n_name FROM nation WHERE n_nationkey < 7
        UNION SELECT 'BLOC_B', n_name FROM nation WHERE n_nationkey < 22 AND n_nationkey % 3 = 0""",
    "years": """
        SELECT CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS year
        FROM (SELECT MIN(year(o_orderdate)) AS lo, MAX(year(o_orderdate)) AS hi FROM orders)""",
    "nation_years": "SELECT n_nationkey, n_name, year FROM nation, years",
    "current_conversion": """
        SELECT year,
               CAST(1.0000 AS DECIMAL(10,4)) AS usd_current,
               CAST(1.2000 + 0.0200 * (year - 1995) AS DECIMAL(10,4)) AS cad_current,
               CAST(0.8000 + 0.0100 * (year - 1995) AS DECIMAL(10,4)) AS eur_current,
               CAST(0.6000 + 0.0050 * (year - 1995) AS DECIMAL(10,4)) AS gbp_current
        FROM years""",
    "constant_conversion": """
        SELECT year, n_name AS country,
               CAST(f AS DECIMAL(10,4)) AS usd_constant,
               CAST(f * 1.3 AS DECIMAL(10,4)) AS cad_constant,
               CASE WHEN n_nationkey % 7 = 3 AND year = 1996 THEN NULL
                    ELSE CAST(f * 0.9 AS DECIMAL(10,4)) END AS eur_constant,
               CAST(f * 0.7 AS DECIMAL(10,4)) AS gbp_constant
        FROM (SELECT *, (1 + 0.0200 * (2001 - year) + 0.0010 * n_nationkey) AS f FROM nation_years
              WHERE n_nationkey < 22)
        WHERE NOT (n_nationkey = 5 AND year = 1997)""",
    "gdp_table": """
        SELECT year, n_name AS country,
               CASE WHEN n_nationkey = 9 AND year = 1998 THEN NULL
                    ELSE CAST(100000.0 * (n_nationkey + 1) + 500.0 * (year - 1995) AS DOUBLE) END AS gdp_constant
        FROM nation_years WHERE n_nationkey < 22""",
    "scaffold": "SELECT year, n_name AS country FROM nation_years WHERE n_nationkey < 22",
    "fx": """
        SELECT 'usd' AS currency, year, CAST(1.0000 AS DECIMAL(10,4)) AS per_usd FROM years
        UNION ALL SELECT 'cad', year, CAST(1.2000 + 0.0200 * (year - 1995) AS DECIMAL(10,4)) FROM years
        UNION ALL SELECT 'eur', year, CAST(0.8000 + 0.0100 * (year - 1995) AS DECIMAL(10,4)) FROM years
        UNION ALL SELECT 'gbp', year, CAST(0.6000 + 0.0050 * (year - 1995) AS DECIMAL(10,4)) FROM years""",
    "deflators": """
        SELECT n_name AS country, year,
               CASE WHEN n_nationkey = 4 AND year = 1999 THEN NULL
                    ELSE 1.0::DOUBLE - 0.015::DOUBLE * CAST(2001 - year AS DOUBLE)
                         + 0.002::DOUBLE * CAST(n_nationkey % 5 AS DOUBLE) END AS deflator,
               1.0::DOUBLE + 0.5::DOUBLE * CAST(n_nationkey AS DOUBLE)
                   + 0.01::DOUBLE * CAST(year - 1995 AS DOUBLE) AS lcu_per_usd
        FROM nation_years""",
    "ngdpd": """
        SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS entity_name,
               'NGDPD' AS indicator_code, 'U.S. dollars' AS unit, year,
               CASE WHEN n_nationkey = 9 AND year = 1998 THEN NULL
                    ELSE (100000.0::DOUBLE * CAST(n_nationkey + 1 AS DOUBLE)
                          + 500.0::DOUBLE * CAST(year - 1995 AS DOUBLE)) / 1000.0::DOUBLE END AS value
        FROM nation_years""",
    "indicators": """
        SELECT * FROM ngdpd
        UNION ALL SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), 'LP', 'Persons', year,
                         10.0::DOUBLE * CAST(n_nationkey + 1 AS DOUBLE) FROM nation_years
        UNION ALL SELECT 'World', 'NGDPD', 'U.S. dollars', year, SUM(value) FROM ngdpd GROUP BY year""",
    "aliases": """
        SELECT n_name AS alias, 'X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3 FROM nation
        UNION ALL SELECT 'X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'),
                         'X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation""",
    "al": "SELECT DISTINCT lower(trim(alias)) AS al, iso3 FROM aliases",
}


def with_fixture(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <body>`` as one statement."""
    parts = dict(CTES)
    if extra:
        parts.update(extra)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return f"WITH {ctes}\n{body}"
