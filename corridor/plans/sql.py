"""The report queries as SQL table functions over the named serving tables.

``register(catalog)`` names the tables (flows, membership, current_conversion,
constant_conversion, gdp_table) and creates one table function per query, so that

    SELECT * FROM top_partners('EUROPE', 1995, 2001, unit => 'eur', flow => 'imports')

runs in any SQL of the session. The functions are SQL themselves: Spark puts their bodies into
the calling query, literal arguments fold away (a request in current prices keeps no trace of the
constant-price table), the year range prunes partitions, and the reporter's members reach the fact
as a semi join instead of a literal list.
"""

from __future__ import annotations

from ..params import ALL_CATEGORIES, ALL_COUNTERPARTS, GDP_UNIT_LABEL, REST_OF_WORLD
from ..sources.files import register_tables
from .catalog import Catalog

TABLES = ("flows", "membership", "current_conversion", "constant_conversion", "gdp_table")

_REQUEST = "reporter STRING, from_year INT, to_year INT, unit STRING DEFAULT 'usd', prices STRING DEFAULT 'current'"
_ONE_SIDE = f"{_REQUEST}, flow STRING DEFAULT 'exports', counterparts STRING DEFAULT '{ALL_COUNTERPARTS}', section STRING DEFAULT '{ALL_CATEGORIES}'"
_MANY = f"reporter STRING, partners ARRAY<STRING>, {_REQUEST.split(', ', 1)[1]}"

_YEARS = "concat(from_year, '-', to_year)"
_UNIT = f"CASE WHEN unit = 'gdp' THEN '{GDP_UNIT_LABEL}' ELSE concat(prices, ' ', unit, ' million') END"
_PER_COUNTRY = "(prices = 'constant' OR unit = 'gdp')"


def _column(kind: str) -> str:
    """The factor column of the unit; a share of GDP is taken of constant US dollars."""
    whens = " ".join(f"WHEN '{u}' THEN {c}_{kind}" for u, c in (("usd", "usd"), ("cad", "cad"), ("eur", "eur"), ("gbp", "gbp"), *((("gdp", "usd"),) if kind == "constant" else ())))
    return f"CASE unit {whens} END"


def _members(name: str) -> str:
    """The members of a group; an unknown name stands for itself."""
    return f"SELECT country FROM membership WHERE group_name = {name} UNION ALL SELECT {name} WHERE {name} NOT IN (SELECT group_name FROM membership)"


#: The reporter's members, the request's factors, GDP by year.
_COMMON = f"""
me AS ({_members('reporter')}),
factors AS (SELECT year AS f_year, CAST(NULL AS STRING) AS f_country, {_column('current')} AS factor FROM current_conversion WHERE NOT {_PER_COUNTRY}
            UNION ALL SELECT year, country, {_column('constant')} FROM constant_conversion WHERE {_PER_COUNTRY}),
gdp AS (SELECT year AS g_year, SUM(gdp_constant) AS gdp FROM gdp_table WHERE country IN (SELECT country FROM me) GROUP BY year)"""


def _side(me: str, other: str, keep: str, columns: str) -> str:
    """The reporter's rows of one side with their converted amount."""
    return f"""SELECT f.year, f.{me} AS member, {columns}, f.value * c.factor AS amount
    FROM flows f JOIN factors c ON f.year = c.f_year AND c.f_country <=> CASE WHEN {_PER_COUNTRY} THEN f.{me} END
    WHERE f.year BETWEEN from_year AND to_year AND f.{me} IN (SELECT country FROM me){keep}"""


def _one_side(key: str) -> str:
    """Q1 (key = counterpart) and Q2 (key = category)."""
    me, other = ("CASE WHEN flow = 'exports' THEN exporter ELSE importer END", "CASE WHEN flow = 'exports' THEN importer ELSE exporter END")
    by_partner = key == "counterpart"
    section = f" AND (section = '{ALL_CATEGORIES}' OR f.category = section)" if by_partner else ""
    out = "k AS partner, flow" if by_partner else f"'{REST_OF_WORLD}' AS partner, k AS category, flow"
    return f"""WITH {_COMMON},
them AS ({_members('counterparts')}),
seen AS (SELECT *, {me} AS me_, {other} AS other_ FROM flows WHERE year BETWEEN from_year AND to_year),
mine AS (SELECT {'f.other_' if by_partner else 'f.category'} AS k, f.value * c.factor AS amount
         FROM seen f JOIN factors c ON f.year = c.f_year AND c.f_country <=> CASE WHEN {_PER_COUNTRY} THEN f.me_ END
         WHERE f.me_ IN (SELECT country FROM me) AND f.other_ NOT IN (SELECT country FROM me)
           AND (counterparts = '{ALL_COUNTERPARTS}' OR f.other_ IN (SELECT country FROM them)){section}),
sums AS (SELECT k, SUM(amount) AS total FROM mine GROUP BY k),
whole AS (SELECT SUM(gdp) AS gdp FROM gdp WHERE g_year BETWEEN from_year AND to_year)
SELECT {_YEARS} AS years, reporter AS country, {out},
       CASE WHEN flow = 'imports' THEN -1 ELSE 1 END
         * CASE WHEN unit = 'gdp' THEN CAST(total AS DOUBLE) / NULLIF((SELECT gdp FROM whole), 0D) * 100D ELSE CAST(total AS DOUBLE) END AS value,
       {_UNIT} AS unit
FROM sums"""


def _share(x: str) -> str:
    return f"CASE WHEN unit = 'gdp' THEN CAST({x} AS DOUBLE) / NULLIF(gdp, 0D) * 100D ELSE CAST({x} AS DOUBLE) END"


#: imports (negative), exports and balance of positive magnitudes e and i; nothing traded is null.
_MEASURES = """NULLIF(COALESCE(-i, 0D), 0D) AS imports, NULLIF(COALESCE(e, 0D), 0D) AS exports,
       CASE WHEN COALESCE(e, 0D) <> 0D OR COALESCE(i, 0D) <> 0D THEN b END AS balance"""
#: Money is subtracted before it becomes a double.
_BALANCE = f"CASE WHEN unit = 'gdp' THEN COALESCE({_share('e')}, 0D) - COALESCE({_share('i')}, 0D) ELSE CAST(COALESCE(e, 0) - COALESCE(i, 0) AS DOUBLE) END"


def _world_trade() -> str:
    """Q3, the published form: a member's year counts where the member exported."""
    keep = f" AND (section = '{ALL_CATEGORIES}' OR f.category = section)"
    return f"""WITH {_COMMON},
both AS ({_side('exporter', 'importer', keep, "'e' AS side")} UNION ALL {_side('importer', 'exporter', keep, "'i' AS side")}),
per AS (SELECT year, member, SUM(CASE WHEN side = 'e' THEN amount END) AS e, SUM(CASE WHEN side = 'i' THEN amount END) AS i,
               COUNT_IF(side = 'e') AS n_e, COUNT_IF(side = 'i') AS n_i FROM both GROUP BY year, member),
lines AS (SELECT CASE WHEN n_e > 0 THEN year END AS year, CASE WHEN n_e > 0 THEN e END AS e, CASE WHEN n_i > 0 THEN i END AS i FROM per
          UNION ALL SELECT explode(sequence(from_year, to_year)), NULL, NULL),
yearly AS (SELECT year, SUM(e) AS e, SUM(i) AS i FROM lines GROUP BY year),
shown AS (SELECT year, {_share('e')} AS e, {_share('i')} AS i, {_BALANCE} AS b FROM yearly LEFT JOIN gdp ON year = g_year)
SELECT year, reporter AS country, '{REST_OF_WORLD}' AS partner, section AS category, {_MEASURES}, {_UNIT} AS unit FROM shown"""


def _pairs(keep: str) -> str:
    """Both sides of the flows between the reporter and the selected groups; a counterpart counts in each of its groups."""
    return f"""chosen AS (SELECT group_name AS partner, country FROM membership WHERE array_contains(partners, group_name)),
both AS (SELECT e.year, p.partner, e.category, e.amount AS e, CAST(NULL AS DECIMAL(38, 10)) AS i
         FROM ({_side('exporter', 'importer', keep, 'f.category, f.importer AS other')}) e JOIN chosen p ON e.other = p.country
         UNION ALL SELECT m.year, p.partner, m.category, NULL, m.amount
         FROM ({_side('importer', 'exporter', keep, 'f.category, f.exporter AS other')}) m JOIN chosen p ON m.other = p.country)"""


def _partner_series() -> str:
    """Q4: every year of the range for every selected group."""
    keep = f" AND (section = '{ALL_CATEGORIES}' OR f.category = section)"
    return f"""WITH {_COMMON}, {_pairs(keep)},
lines AS (SELECT year, partner, e, i FROM both
          UNION ALL SELECT explode(sequence(from_year, to_year)), partner, NULL, NULL FROM (SELECT DISTINCT partner FROM chosen)),
yearly AS (SELECT year, partner, SUM(e) AS e, SUM(i) AS i FROM lines GROUP BY year, partner),
shown AS (SELECT year, partner, {_share('e')} AS e, {_share('i')} AS i, {_BALANCE} AS b FROM yearly LEFT JOIN gdp ON year = g_year)
SELECT year, reporter AS country, partner, section AS category, {_MEASURES}, {_UNIT} AS unit FROM shown"""


def _partner_matrix() -> str:
    """Q5: sums of money, or means of the yearly shares in the order of their years."""
    def total(x: str) -> str:
        mean = f"aggregate(array_sort(collect_list(struct(year, {x} AS v))), 0D, (acc, y) -> acc + y.v)"
        return f"CASE WHEN unit = 'gdp' THEN {mean} / COUNT(*) ELSE CAST(SUM({x}m) AS DOUBLE) END"

    return f"""WITH {_COMMON}, {_pairs('')},
yearly AS (SELECT year, partner, category, SUM(e) AS e, SUM(i) AS i FROM both GROUP BY year, partner, category),
shares AS (SELECT year, partner, category, COALESCE(e, 0) AS em, -COALESCE(i, 0) AS im, COALESCE(e, 0) - COALESCE(i, 0) AS bm,
                  COALESCE({_share('e')}, 0D) AS e, COALESCE(-({_share('i')}), 0D) AS i, COALESCE({_share('e')}, 0D) - COALESCE({_share('i')}, 0D) AS b
           FROM yearly JOIN gdp ON year = g_year)
SELECT {_YEARS} AS years, reporter AS country, partner, category, {total('i')} AS imports,
       {total('e')} AS exports, {total('b')} AS balance, {_UNIT} AS unit
FROM shares GROUP BY partner, category"""


#: name -> (parameters, columns, body)
FUNCTIONS = {
    "top_partners": (_ONE_SIDE, "years STRING, country STRING, partner STRING, flow STRING, value DOUBLE, unit STRING", _one_side("counterpart")),
    "top_categories": (_ONE_SIDE.rsplit(", ", 1)[0], "years STRING, country STRING, partner STRING, category STRING, flow STRING, value DOUBLE, unit STRING", _one_side("category")),
    "world_trade": (f"{_REQUEST}, section STRING DEFAULT '{ALL_CATEGORIES}'",
                    "year INT, country STRING, partner STRING, category STRING, imports DOUBLE, exports DOUBLE, balance DOUBLE, unit STRING", _world_trade()),
    "partner_series": (f"{_MANY}, section STRING DEFAULT '{ALL_CATEGORIES}'",
                       "year INT, country STRING, partner STRING, category STRING, imports DOUBLE, exports DOUBLE, balance DOUBLE, unit STRING", _partner_series()),
    "partner_matrix": (_MANY, "years STRING, country STRING, partner STRING, category STRING, imports DOUBLE, exports DOUBLE, balance DOUBLE, unit STRING", _partner_matrix()),
}


def register(cat: Catalog) -> None:
    """Name the catalogue's tables in its session and create the table functions; a second call replaces both."""
    register_tables(cat.spark, dict(zip(TABLES, (cat.flows, cat.membership, cat.current, cat.constant, cat.gdp), strict=True)))
    for name, (parameters, columns, body) in FUNCTIONS.items():
        cat.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
