"""Readers for the product's own inputs: yearly flow CSVs, code lists, JSON settings, indicator tables.

All schemas are explicit (no inference pass) and every multi-file input is one
distributed scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.joins import unique


def _read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Header CSVs read by column name: each file's own header decides the order of its columns.

    A missing column and a malformed cell raise; other columns are ignored. Files of a path
    pattern must agree on their header (checked by the reader).
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in want.fields}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        header = tuple(spark.read.option("header", True).csv(path).columns)
        if missing := [n for n in types if n not in header]:
            raise ValueError(f"{path}: no column {', '.join(missing)}")
        by_header.setdefault(header, []).append(path)
    parts = [
        spark.read.schema(T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header]))
        .option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(same).select(*types)
        for header, same in by_header.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_raw_flows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every yearly flow file in one scan (S1); the product code stays a string."""
    return _read_csv(spark, paths, schemas.RAW_FLOWS)


def yearly_paths(directory: str, years: Iterable[int], pattern: str = "flows_{year}.csv",
                 version: str = "") -> list[str]:
    """File names of the yearly flow files of a range."""
    return [f"{directory.rstrip('/')}/{pattern.format(year=y, version=version)}" for y in years]


def read_country_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code list CSV (S2); of a code's rows the last one in the file counts."""
    rows = _read_csv(spark, path, schemas.COUNTRY_CODES)
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    last = numbered.groupBy("country_code").agg(F.max_by(F.struct(*rows.columns), "_at").alias("row"))
    return last.select("row.*")


def _json_map(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    # a JSON object with data-dependent keys: parse it as one map value rather
    # than letting the JSON reader turn every key into a column
    return spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("m"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """D3: ``{section: [chapters]}`` -> (category, chapters[]) (S3); a chapter belongs to the last section that lists it."""
    own = """transform(map_entries(m), (e, i) -> named_struct('category', e.key, 'chapters', array_distinct(filter(e.value,
        c -> NOT exists(slice(map_entries(m), i + 2, size(m)), later -> array_contains(later.value, c))))))"""
    return _json_map(spark, path, schemas.SECTIONS_JSON).select(F.explode(F.expr(own)).alias("s")).select("s.category", "s.chapters")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """``{country: {groups: [...]}}`` -> (country, groups[]); missing lists become empty."""
    return _json_map(spark, path, schemas.COUNTRIES_JSON).select(F.explode("m").alias("country", "v")).select(
        "country", F.coalesce(F.col("v.groups"), F.array().cast("array<string>")).alias("groups"))


def read_indicators(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long macro-indicator table supplied by the user (S6, re-aimed from a web download)."""
    if fmt == "csv":
        return _read_csv(spark, path, schemas.INDICATORS)
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schemas.INDICATORS.fields])


def read_csv_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A header CSV with an explicit schema (fx rates, deflators, aliases)."""
    return _read_csv(spark, path, schema)


def scaffold(countries: DataFrame, time_range: tuple[int, int]) -> DataFrame:
    """(year, country) for every covered country and year of the range, without a join."""
    y0, y1 = time_range
    return countries.select(F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year"), "country")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The one-row coverage table."""
    return _read_csv(spark, path, schemas.COVERAGE)


def read_factor_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """D7/D8/D9 written by the builders (header CSV), typed explicitly."""
    cur = schemas.CURRENCIES
    if kind == "current":
        ddl = "year INT, " + ", ".join(f"{c}_current DECIMAL(20,10)" for c in cur)
    elif kind == "constant":
        ddl = "year INT, country STRING, " + ", ".join(f"{c}_constant DECIMAL(20,10)" for c in cur)
    elif kind == "gdp":
        ddl = "year INT, country STRING, gdp_constant DOUBLE"
    else:
        raise ValueError(kind)
    return unique(_read_csv(spark, path, ddl), ["year"] if kind == "current" else ["year", "country"], f"{kind} table")


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Name tables for SQL users, as the product registers its four files."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def literal_relation(spark: SparkSession, values: Sequence[str], column: str = "value") -> DataFrame:
    """A literal list as a one-column relation."""
    return spark.createDataFrame([(v,) for v in values], f"{column} string")
