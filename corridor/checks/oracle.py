"""Oracle SQL (DuckDB) for the queries, over the fixture CTEs.

Written from the query semantics, not generated from the Spark plans: group
resolution is a sub-select on the membership table, conversion a plain join.
Measures are cast to DOUBLE and not rounded.
"""

from __future__ import annotations

from ..params import ALL_CATEGORIES, ALL_COUNTERPARTS, REST_OF_WORLD, Params
from .fixture_sql import with_fixture


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _out(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _members(name: str) -> str:
    return f"(SELECT country FROM membership WHERE group_name = {q(name)})"


def _conv(p: Params) -> str:
    if p.per_country_factor:
        return (f"SELECT year, country, {p.factor_column} AS factor FROM constant_conversion "
                f"WHERE country IN {_members(p.country)}")
    return f"SELECT year, {p.factor_column} AS factor FROM current_conversion"


def _factor_on(p: Params, col: str) -> str:
    return f"f.year = c.year AND f.{col} = c.country" if p.per_country_factor else "f.year = c.year"


def _cat_filter(category: str | None) -> str:
    return "" if not category or category == ALL_CATEGORIES else f" AND f.category = {q(category)}"


def _share(x: str, gdp: str = "g.gdp") -> str:
    return f"(CAST({x} AS DOUBLE) / NULLIF({gdp}, 0) * 100)"


def one_side(p: Params, by: str) -> str:
    """Q1 (by='partner') and Q2 (by='category')."""
    me, other = ("exporter", "importer") if p.flow == "exports" else ("importer", "exporter")
    y0, y1 = p.years
    cp = "" if p.group == ALL_COUNTERPARTS else f" AND f.{other} IN {_members(p.group)}"
    cat = _cat_filter(p.category if by == "partner" else None)
    key = f"f.{other}" if by == "partner" else "f.category"
    body_total = _share("a.total", "(SELECT gdp FROM gdp)") if p.is_gdp else "a.total"
    sign = "-" if p.flow == "imports" else ""
    extra = {
        "conv": _conv(p),
        "sel": f"""SELECT {key} AS k, f.value * c.factor AS amount
                   FROM flows f JOIN conv c ON {_factor_on(p, me)}
                   WHERE f.{me} IN {_members(p.country)} AND f.{other} NOT IN {_members(p.country)}{cp}
                     AND f.year BETWEEN {y0} AND {y1}{cat}""",
        "gdp": f"""SELECT SUM(gdp_constant) AS gdp FROM gdp_table
                   WHERE country IN {_members(p.country)} AND year BETWEEN {y0} AND {y1}""",
        "agg": "SELECT k, SUM(amount) AS total FROM sel GROUP BY k",
    }
    label = "a.k AS partner" if by == "partner" else f"{q(REST_OF_WORLD)} AS partner, a.k AS category"
    return with_fixture(
        f"""SELECT {q(p.years_label)} AS years, {q(p.country)} AS country, {label}, {q(p.flow)} AS flow,
                   {_out(f"{sign}{body_total}")} AS value, {q(p.unit_label)} AS unit
            FROM agg a""",
        extra,
    )


def top_partners(p: Params) -> str:
    return one_side(p, "partner")


def top_categories(p: Params) -> str:
    return one_side(p, "category")


def _side_cte(p: Params, me: str, extra_where: str = "", group_cols: str = "", join: str = "",
              out_col: str = "amount") -> str:
    y0, y1 = p.years
    sel = f"f.year{', ' + group_cols if group_cols else ''}"
    return f"""SELECT {sel}, SUM(f.value * c.factor) AS {out_col}
               FROM flows f JOIN conv c ON {_factor_on(p, me)} {join}
               WHERE f.{me} IN {_members(p.country)} AND f.year BETWEEN {y0} AND {y1}{extra_where}
               GROUP BY ALL"""


def world_trade(p: Params, fixed: bool = False) -> str:
    """Q3, the published outer-join form by default, the stacked form when fixed."""
    y0, y1 = p.years
    cat = _cat_filter(p.category)
    extra = {
        "conv": _conv(p),
        "ex": _side_cte(p, "exporter", cat, "f.exporter AS country", out_col="exports"),
        "im": _side_cte(p, "importer", cat, "f.importer AS country", out_col="imports"),
        "gy": f"SELECT year, SUM(gdp_constant) AS gdp FROM gdp_table WHERE country IN {_members(p.country)} GROUP BY year",
        "sp": f"SELECT CAST(range AS INTEGER) AS year FROM range({y0}, {y1 + 1})",
    }
    # a year has one GDP: exact sums are divided, not shares summed
    if p.is_gdp:
        e, i = _share("SUM(e.exports)", "MAX(g.gdp)"), _share("SUM(i.imports)", "MAX(g.gdp)")
    else:
        e, i = "SUM(e.exports)", "SUM(i.imports)"
    imp = f"NULLIF(COALESCE(-{i}, 0), 0)"
    exp = f"NULLIF(COALESCE({e}, 0), 0)"
    bal = f"CASE WHEN {imp} IS NULL AND {exp} IS NULL THEN NULL ELSE COALESCE({e}, 0) - COALESCE({i}, 0) END"
    if fixed:
        extra["ey"] = "SELECT year, SUM(exports) AS exports FROM ex GROUP BY year"
        extra["iy"] = "SELECT year, SUM(imports) AS imports FROM im GROUP BY year"
        frm = ("sp LEFT JOIN ey e ON sp.year = e.year LEFT JOIN iy i ON sp.year = i.year "
               "LEFT JOIN gy g ON sp.year = g.year")
    else:
        frm = ("sp LEFT JOIN ex e ON sp.year = e.year "
               "FULL OUTER JOIN im i ON sp.year = i.year AND e.country = i.country "
               "LEFT JOIN gy g ON sp.year = g.year")
    return with_fixture(
        f"""SELECT sp.year AS year, {q(p.country)} AS country, {q(REST_OF_WORLD)} AS partner,
                   {q(p.category)} AS category, {_out(imp)} AS imports, {_out(exp)} AS exports,
                   {_out(bal)} AS balance, {q(p.unit_label)} AS unit
            FROM {frm}
            GROUP BY sp.year ORDER BY sp.year NULLS LAST""",
        extra,
    )


def _multi_ctes(p: Params, by_category: bool, groups) -> dict[str, str]:
    cat = "" if by_category else _cat_filter(p.category)
    names = ", ".join(q(g) for g in groups) or "NULL"
    cols = "pm.partner, f.category" if by_category else "pm.partner"
    return {
        "conv": _conv(p),
        "pm": f"SELECT group_name AS partner, country FROM membership WHERE group_name IN ({names})",
        "ex": _side_cte(p, "exporter", cat, cols, "JOIN pm ON f.importer = pm.country", "exports"),
        "im": _side_cte(p, "importer", cat, cols, "JOIN pm ON f.exporter = pm.country", "imports"),
        "gy": f"SELECT year, SUM(gdp_constant) AS gdp FROM gdp_table WHERE country IN {_members(p.country)} GROUP BY year",
    }


def partner_series(p: Params, groups) -> str:
    """Q4: year x selected partner group, both flows."""
    y0, y1 = p.years
    extra = _multi_ctes(p, False, groups)
    extra["yp"] = (f"SELECT CAST(unnest(range({y0}, {y1 + 1})) AS INTEGER) AS year, partner "
                   f"FROM (SELECT DISTINCT partner FROM pm)")
    if p.is_gdp:
        e, i = _share("e.exports"), _share("i.imports")
    else:
        e, i = "e.exports", "i.imports"
    imp = f"NULLIF(COALESCE(-{i}, 0), 0)"
    exp = f"NULLIF(COALESCE({e}, 0), 0)"
    bal = f"CASE WHEN {imp} IS NULL AND {exp} IS NULL THEN NULL ELSE COALESCE({e}, 0) - COALESCE({i}, 0) END"
    return with_fixture(
        f"""SELECT yp.year AS year, {q(p.country)} AS country, yp.partner AS partner, {q(p.category)} AS category,
                   {_out(imp)} AS imports, {_out(exp)} AS exports, {_out(bal)} AS balance, {q(p.unit_label)} AS unit
            FROM yp LEFT JOIN ex e ON yp.year = e.year AND yp.partner = e.partner
                    LEFT JOIN im i ON yp.year = i.year AND yp.partner = i.partner
                    LEFT JOIN gy g ON yp.year = g.year
            ORDER BY yp.partner, yp.year""",
        extra,
    )


def partner_matrix(p: Params, groups) -> str:
    """Q5: partner group x category over the period; AVG of yearly shares for GDP, else SUM."""
    extra = _multi_ctes(p, True, groups)
    extra["t"] = """SELECT COALESCE(e.year, i.year) AS year, COALESCE(e.partner, i.partner) AS partner,
                           COALESCE(e.category, i.category) AS category, e.exports, i.imports
                    FROM ex e FULL OUTER JOIN im i
                      ON e.year = i.year AND e.partner = i.partner AND e.category = i.category"""
    if p.is_gdp:
        e, i = _share("t.exports"), _share("t.imports")
    else:
        e, i = "t.exports", "t.imports"
    extra["r"] = f"""SELECT t.year, t.partner, t.category, COALESCE(-{i}, 0) AS imports, COALESCE({e}, 0) AS exports,
                            COALESCE({e}, 0) - COALESCE({i}, 0) AS balance
                     FROM t JOIN gy g ON t.year = g.year"""

    def agg(c: str) -> str:  # shares are doubles: added in the order of the years
        return f"list_reduce(list_prepend(0.0::DOUBLE, list({c} ORDER BY year)), lambda a, b: a + b) / COUNT(*)" if p.is_gdp else f"SUM({c})"

    return with_fixture(
        f"""SELECT {q(p.years_label)} AS years, {q(p.country)} AS country, partner, category,
                   {_out(agg("imports"))} AS imports, {_out(agg("exports"))} AS exports,
                   {_out(agg("balance"))} AS balance, {q(p.unit_label)} AS unit
            FROM r GROUP BY partner, category ORDER BY partner, category""",
        extra,
    )
