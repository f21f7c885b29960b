"""Command line: build the serving tables, run a report query, export it.

    python -m corridor.cli build --raw 'raw/flows_*.csv' --codes codes.csv --sections hs_sections.json \
        --countries countries.json --current cur.csv --constant const.csv --gdp gdp.csv \
        --years 2002 2023 --out /shared/serving
    python -m corridor.cli query top_partners --root /shared/serving --country Kenya --years 2010 2020 \
        --unit usd --prices constant --flow exports --export /shared/results
    python -m corridor.cli current-factors --fx fx.csv --years 2002 2023 --out cur
    python -m corridor.cli constant-factors --countries countries.json --deflators defl.csv --fx fx.csv \
        --years 2002 2023 --base-year 2023 --out const
    python -m corridor.cli gdp --countries countries.json --indicators ind.csv --aliases aliases.csv \
        --deflators defl.csv --base-country USA --years 2002 2023 --base-year 2023 --out gdp
    python -m corridor.cli coverage --countries countries.json --indicators ind.csv --aliases aliases.csv \
        --year 2023 --out coverage
"""

from __future__ import annotations

import argparse
import csv
import sys

from . import schemas
from .operators import convert, coverage
from .params import ALL_CATEGORIES, ALL_COUNTERPARTS, Params
from .plans import jobs, multi, single
from .sinks.files import export_result, file_name, write_table
from .sources import files

QUERIES = {
    "top_partners": single.top_partners,
    "top_categories": single.top_categories,
    "world_trade": single.world_trade,
    "partner_series": multi.partner_series,
    "partner_matrix": multi.partner_matrix,
}


def main(argv=None) -> None:
    from pyspark.sql import SparkSession

    ap = argparse.ArgumentParser(prog="corridor")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    for a in ("raw", "codes", "sections", "countries", "current", "constant", "gdp", "out"):
        b.add_argument(f"--{a}", required=True)
    b.add_argument("--years", nargs=2, type=int, required=True)
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("--root", required=True)
    q.add_argument("--country", required=True)
    q.add_argument("--years", nargs=2, type=int, required=True)
    q.add_argument("--unit", default="usd")
    q.add_argument("--prices", default="current")
    q.add_argument("--flow", default="exports")
    q.add_argument("--category", default=ALL_CATEGORIES)
    q.add_argument("--group", default=ALL_COUNTERPARTS)
    q.add_argument("--partners", nargs="*", default=[])
    q.add_argument("--export")
    c = sub.add_parser("current-factors")
    c.add_argument("--fx", required=True)
    c.add_argument("--years", nargs=2, type=int, required=True)
    c.add_argument("--out", required=True)
    k = sub.add_parser("constant-factors")
    for a in ("countries", "deflators", "fx", "out"):
        k.add_argument(f"--{a}", required=True)
    k.add_argument("--years", nargs=2, type=int, required=True)
    k.add_argument("--base-year", type=int, required=True)
    g = sub.add_parser("gdp")
    for a in ("countries", "indicators", "aliases", "deflators", "base-country", "out"):
        g.add_argument(f"--{a}", required=True)
    g.add_argument("--years", nargs=2, type=int, required=True)
    g.add_argument("--base-year", type=int, required=True)
    v = sub.add_parser("coverage")
    for a in ("countries", "indicators", "aliases", "out"):
        v.add_argument(f"--{a}", required=True)
    v.add_argument("--year", type=int, required=True)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    if args.cmd == "build":
        jobs.build_serving_tables(spark, raw_paths=[args.raw], country_codes=args.codes, sections=args.sections,
                                  countries=args.countries, current=args.current, constant=args.constant,
                                  gdp=args.gdp, out_root=args.out, time_range=tuple(args.years))
        return
    if args.cmd in ("current-factors", "constant-factors", "gdp", "coverage"):
        write_table(_builder(spark, args), args.out, "csv", mode="overwrite")  # header CSV, as `build` reads
        return
    cat = jobs.load_catalog(spark, args.root)
    p = Params(args.country, tuple(args.years), unit=args.unit, prices=args.prices, category=args.category,
               flow=args.flow, group=args.group, partners=tuple(args.partners))
    df = QUERIES[args.name](cat, p)
    if args.export:
        print(export_result(df, args.export, file_name(args.name, p)))
    else:  # every row, a partition at a time
        lines = csv.writer(sys.stdout)
        lines.writerow(df.columns)
        lines.writerows(df.toLocalIterator())


def _builder(spark, args):
    """T3-T6 from user-supplied tables (the rates, deflators and indicators the product downloads)."""
    if args.cmd == "current-factors":
        y0, y1 = args.years
        years = spark.range(y0, y1 + 1).selectExpr("CAST(id AS INT) AS year")
        return convert.build_current_factors(files.read_csv_table(spark, args.fx, schemas.FX), years)
    countries = files.read_countries(spark, args.countries)
    if args.cmd == "coverage":
        return coverage.build_coverage(countries, files.read_indicators(spark, args.indicators, "csv"),
                                       files.read_csv_table(spark, args.aliases, schemas.ALIASES), args.year)
    grid = files.scaffold(countries, tuple(args.years))
    deflators = files.read_csv_table(spark, args.deflators, schemas.DEFLATORS)
    if args.cmd == "constant-factors":
        return convert.build_constant_factors(grid, deflators, files.read_csv_table(spark, args.fx, schemas.FX),
                                              args.base_year)
    return coverage.build_gdp(grid, files.read_indicators(spark, args.indicators, "csv"),
                              files.read_csv_table(spark, args.aliases, schemas.ALIASES), deflators,
                              args.base_country, args.base_year)


if __name__ == "__main__":
    main()
