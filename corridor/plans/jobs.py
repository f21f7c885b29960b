"""Batch jobs over the product's own inputs: build the serving tables, load them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import membership as mem
from ..operators import normalize
from ..sinks.clustering import write_clustered
from ..sinks.files import get_text, put_text, write_dimensions, write_table, write_wide
from ..sources import files
from .catalog import Catalog

POINTER = "CURRENT"


def build_serving_tables(spark: SparkSession, *, raw_paths: Sequence[str], country_codes: str, sections: str,
                         countries: str, current: str, constant: str, gdp: str, out_root: str,
                         time_range: tuple[int, int], wide: bool = False) -> Catalog:
    """T1 + T2 end to end: one scan of every yearly file, then the small tables (K1, K4).

    ``current``/``constant``/``gdp`` are the header CSVs of the factor and GDP
    builders. Everything lands in a folder of its own under ``out_root`` as
    Parquet, and a pointer there names it once all tables are complete, so a
    reader never sees a half-built or mixed set; ``wide`` also writes the
    pivoted view (one column per category) read back from the long fact, so the
    raw files are scanned once.
    """
    build = f"build-{uuid.uuid4().hex}"
    out = f"{out_root.rstrip('/')}/{build}"
    sec = files.read_sections(spark, sections)
    cty = files.read_countries(spark, countries)
    flows = normalize.build_flows(files.read_raw_flows(spark, raw_paths), sec,
                                  files.read_country_codes(spark, country_codes), cty)
    write_clustered(flows, f"{out}/flows", cty)
    cats = [r[0] for r in sec.select("category").collect()]  # the section list: a few dozen names
    if wide:
        write_wide(normalize.to_wide(spark.read.parquet(f"{out}/flows"), sorted(cats)), f"{out}/flows_wide")
    membership = mem.build_membership(cty)
    write_table(membership, f"{out}/membership")
    for kind, path in (("current", current), ("constant", constant), ("gdp", gdp)):
        write_table(files.read_factor_table(spark, path, kind), f"{out}/{kind}")
    y0, y1 = time_range
    write_dimensions(
        spark.createDataFrame([(y0, y1)], "min_year int, max_year int"),
        sec.select("category"),
        mem.group_members(membership),
        f"{out}/dims",
    )
    put_text(spark, f"{out_root.rstrip('/')}/{POINTER}", build)
    return load_catalog(spark, out_root)


def serving_root(spark: SparkSession, root: str) -> str:
    """The folder of the last complete build under ``root``."""
    root = root.rstrip("/")
    return f"{root}/{get_text(spark, f'{root}/{POINTER}')}"


def load_catalog(spark: SparkSession, root: str) -> Catalog:
    """Open the serving tables of the last complete ``build_serving_tables``."""
    root = serving_root(spark, root)
    cats = [r[0] for r in spark.read.json(f"{root}/dims/categories").select("category").collect()]
    return Catalog.from_tables(
        spark,
        spark.read.parquet(f"{root}/flows"),
        spark.read.parquet(f"{root}/membership"),
        spark.read.parquet(f"{root}/current"),
        spark.read.parquet(f"{root}/constant"),
        spark.read.parquet(f"{root}/gdp").select("year", "country", F.col("gdp_constant").cast("double")),
        cats,
    )
