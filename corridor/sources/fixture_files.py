"""The fixture as the product's own input files: yearly CSVs, a code list with damaged names, JSON settings.

Spark writes them under the shared folder from the driver's tables, so the
whole file path (readers, ETL, serving tables, queries) runs on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import write_table
from . import fixture

ACCENTED = 5        # nations divisible by 5 have an accented name in these files


def accented(name: Column, key: Column) -> Column:
    return F.concat(name, F.when(key % ACCENTED == 0, F.lit("é")).otherwise(F.lit("")))


def _damaged(name: Column) -> Column:
    """UTF-8 bytes read as Latin-1, as in the published code lists."""
    return F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")


def _object(df: DataFrame, key: str, value: Column, path: str) -> None:
    """One JSON object with a key per row (a settings file: a few dozen rows)."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))
    df.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)


def deliver(raw: DataFrame, path: str) -> None:
    """Raw rows as more header CSVs in a folder."""
    raw.select("j", "i", "t", "k", F.lit("").alias("q"), "v").write.mode("append").option("header", True).csv(path)


def write_indicators(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The macro indicators as header CSVs."""
    write_table(fixture.indicators(spark, sf_dir), path, "csv")
    return path


def write_inputs(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """Write every input under ``root``; the keyword arguments of ``build_serving_tables`` that name them."""
    deliver(fixture.raw_flows(spark, sf_dir), f"{root}/raw")  # columns in an order of their own
    codes = fixture.country_codes(spark, sf_dir)
    codes.withColumn("country_name", _damaged(accented(F.col("country_name"), F.col("country_code")))).write.option("header", True).csv(f"{root}/codes")
    _object(fixture.sections(spark), "category", F.col("chapters"), f"{root}/sections")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("country"), "n_nationkey")
    named = fixture.countries(spark, sf_dir).join(nation, "country").withColumn("country", accented(F.col("country"), F.col("n_nationkey")))
    _object(named, "country", F.struct("groups"), f"{root}/countries")
    from ..operators import convert

    years = fixture.years(spark, sf_dir)
    for name, table in (("current", convert.build_current_factors(fixture.fx(spark, years), years)),
                        ("constant", fixture.constant_conversion(spark, sf_dir)), ("gdp", fixture.gdp_table(spark, sf_dir))):
        write_table(table, f"{root}/{name}", "csv")
    return {"raw_paths": [f"{root}/raw"], "country_codes": f"{root}/codes"} | {
        k: f"{root}/{k}" for k in ("sections", "countries", "current", "constant", "gdp")}
