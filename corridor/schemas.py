"""Explicit schemas: no inference pass anywhere, stable types for every input."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE_TYPE = T.DecimalType(18, 2)       # long fact measure, million USD
WIDE_VALUE_TYPE = T.DecimalType(18, 2)  # wide serving view: as wide as the long fact

# Raw product-level flows, one CSV per year (thousand USD).
RAW_FLOWS = T.StructType([
    T.StructField("t", T.IntegerType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("k", T.StringType()),      # product code, leading zeros kept
    T.StructField("v", T.DecimalType(24, 6)),   # decimal: sums do not depend on task order
    T.StructField("q", T.StringType()),      # quantity, unused
])

# Country code dimension.
COUNTRY_CODES = T.StructType([
    T.StructField("country_code", T.IntegerType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("country_iso2", T.StringType()),
    T.StructField("country_iso3", T.StringType()),
])

# D3 / D4 as they sit in the JSON settings files (dynamic keys).
SECTIONS_JSON = "map<string,array<string>>"
COUNTRIES_JSON = "map<string,struct<groups:array<string>>>"

# D6 long form (primary serving table).
FLOWS = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("exporter", T.StringType()),
    T.StructField("importer", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("value", VALUE_TYPE),
])

MEMBERSHIP = T.StructType([
    T.StructField("group_name", T.StringType()),
    T.StructField("country", T.StringType()),
])

# Long macro-indicator table.
INDICATORS = T.StructType([
    T.StructField("entity_name", T.StringType()),
    T.StructField("indicator_code", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

FX = T.StructType([
    T.StructField("currency", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("per_usd", T.DoubleType()),
])

DEFLATORS = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("deflator", T.DoubleType()),
    T.StructField("lcu_per_usd", T.DoubleType()),
])

ALIASES = T.StructType([
    T.StructField("alias", T.StringType()),
    T.StructField("iso3", T.StringType()),
])

COVERAGE = T.StructType([
    T.StructField("n_countries", T.IntegerType()),
    T.StructField("gdp_share", T.DoubleType()),
    T.StructField("pop_share", T.DoubleType()),
])

# Currencies of the factor tables, in their column order.
CURRENCIES = ("usd", "cad", "eur", "gbp")
