"""The serving tables a query reads, bundled once per dataset."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import convert, membership as mem, normalize
from ..operators.joins import DIM_ROW_LIMIT, is_small
from ..session import shared_dir
from ..sinks import files as sinks_files
from ..sinks import clustering
from ..sinks.clustering import write_clustered
from ..sinks.files import file_states, materialize
from ..sources import files, fixture


@dataclass
class Catalog:
    """Serving tables plus the small lookups resolved on the driver.

    ``groups`` maps every group name to its sorted members (each country is
    its own group); it is the membership dimension collected once, after its
    size was checked, exactly like the generated lookup the reference ships.
    """

    spark: SparkSession
    flows: DataFrame          # year, exporter, importer, category, value
    membership: DataFrame     # group_name, country
    current: DataFrame        # year, usd_current, cad_current, eur_current, gbp_current
    constant: DataFrame       # year, country, usd_constant, ...
    gdp: DataFrame            # year, country, gdp_constant
    categories: tuple[str, ...]
    groups: dict[str, tuple[str, ...]]
    broadcastable: frozenset[str] = frozenset()   # dimensions whose size check passed

    @classmethod
    def from_tables(cls, spark, flows, membership, current, constant, gdp, categories) -> "Catalog":
        # membership becomes the driver-side group lookup, so it must be small
        if not is_small(membership, DIM_ROW_LIMIT):
            raise ValueError(f"membership exceeds {DIM_ROW_LIMIT} rows")
        # factor tables are broadcast when small, else joined by shuffle
        ok = frozenset(n for n, d in (("current", current), ("constant", constant), ("gdp", gdp))
                       if is_small(d, DIM_ROW_LIMIT))
        pairs = membership.groupBy("group_name").agg(F.sort_array(F.collect_set("country")).alias("m")).collect()
        groups = {r["group_name"]: tuple(r["m"]) for r in pairs}
        return cls(spark, flows, membership, current, constant, gdp, tuple(sorted(categories)), groups, ok)

    def members(self, names) -> tuple[str, ...]:
        return mem.members_of(self.groups, names)

    @property
    def countries(self) -> tuple[str, ...]:
        """Covered countries: the single-member groups named after themselves."""
        return tuple(sorted(g for g, m in self.groups.items() if m == (g,)))


_cache: dict[tuple, Catalog] = {}


class _Sources(dict):
    """Fixture inputs built on first use (some builders check sizes eagerly)."""

    def __init__(self, makers):
        super().__init__()
        self._makers = makers

    def __missing__(self, key):
        value = self[key] = self._makers[key]()
        return value


def fixture_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every input of the fixture dataset, derived from the driver's tables on demand."""
    return _Sources({
        "raw": lambda: fixture.raw_flows(spark, sf_dir),
        "country_codes": lambda: fixture.country_codes(spark, sf_dir),
        "countries": lambda: fixture.countries(spark, sf_dir),
        "sections": lambda: fixture.sections(spark),
        "membership": lambda: mem.build_membership(fixture.countries(spark, sf_dir)),
        "current": lambda: convert.build_current_factors(
            fixture.fx(spark, fixture.years(spark, sf_dir)), fixture.years(spark, sf_dir)),
        "constant": lambda: fixture.constant_conversion(spark, sf_dir),
        "gdp": lambda: fixture.gdp_table(spark, sf_dir),
    })


def fixture_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over the fixture, lazily."""
    s = fixture_sources(spark, sf_dir)
    return normalize.build_flows(s["raw"], s["sections"], s["country_codes"], s["countries"])


def _build_key(spark: SparkSession, sf_dir: str) -> str:
    """Names a materialised copy by its input files (path, length, time) and by the code that builds it."""
    seen = hashlib.sha1()
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        seen.update("|".join(file_states(spark, f"{sf_dir}/{name}.parquet")).encode())
    for module in (fixture, convert, mem, normalize, measures, sinks_files, clustering):
        with open(module.__file__, "rb") as f:
            seen.update(f.read())
    return seen.hexdigest()[:16]


def fixture_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Build (once) and load the serving tables of a fixture directory.

    The flow fact and the dimensions are written under the shared folder the
    session names (``spark.checkpoint.dir``) and read back, so every query
    starts from compact files instead of re-running the ETL join. A failure to
    write them is an error, not a reason to run the ETL in every query.
    """
    sf_dir = sf_dir.rstrip("/")
    build = _build_key(spark, sf_dir)  # changed inputs are another key: an open session doesn't answer from the old ones
    key = (spark.sparkContext.applicationId, sf_dir, build)
    if key in _cache:
        return _cache[key]
    s = fixture_sources(spark, sf_dir)
    flows = normalize.build_flows(s["raw"], s["sections"], s["country_codes"], s["countries"])
    root = f"{shared_dir(spark)}/corridor/fixture-{build}"
    flows = materialize(spark, flows, f"{root}/flows", writer=lambda df, path: write_clustered(df, path, s["countries"]))
    tables = {n: materialize(spark, s[n], f"{root}/{n}") for n in ("membership", "current", "constant", "gdp")}
    cats = [r[0] for r in s["sections"].select("category").distinct().collect()]
    cat = Catalog.from_tables(spark, flows, tables["membership"], tables["current"], tables["constant"],
                              tables["gdp"], cats)
    _cache[key] = cat
    return cat


_file_builds: dict[tuple, str] = {}


def fixture_file_build(spark: SparkSession, sf_dir: str) -> str:
    """The fixture written as the product's input files and built into serving tables; once per session."""
    from . import jobs
    from ..sources import fixture_files

    key = (spark.sparkContext.applicationId, sf_dir, _build_key(spark, sf_dir.rstrip("/")))
    if key not in _file_builds:
        root = f"{shared_dir(spark)}/corridor/files-{uuid.uuid4().hex}"
        inputs = fixture_files.write_inputs(spark, sf_dir.rstrip("/"), f"{root}/in")
        jobs.build_serving_tables(spark, **inputs, out_root=f"{root}/out", time_range=fixture.time_range(spark, sf_dir))
        _file_builds[key] = root
    return _file_builds[key]


def fixture_refreshed(spark: SparkSession, sf_dir: str) -> str:
    """The fixture's raw files in two deliveries, the fact brought up to date after each; once per session.

    The second delivery holds later years and more rows of a year that was already built.
    """
    from . import refresh
    from ..sources import fixture_files

    key = (spark.sparkContext.applicationId, sf_dir, _build_key(spark, sf_dir.rstrip("/")), "refreshed")
    if key not in _file_builds:
        root = f"{shared_dir(spark)}/corridor/refreshed-{uuid.uuid4().hex}"
        inputs = fixture_file_build(spark, sf_dir)
        dims = (files.read_sections(spark, f"{inputs}/in/sections"), files.read_country_codes(spark, f"{inputs}/in/codes"), files.read_countries(spark, f"{inputs}/in/countries"))
        y0, y1 = fixture.time_range(spark, sf_dir)
        middle = (y0 + y1) // 2
        early = (F.col("t") < middle) | ((F.col("t") == middle) & (F.col("j") % 2 == 0))
        for delivery in (early, ~early):
            fixture_files.deliver(fixture.raw_flows(spark, sf_dir).where(delivery), f"{root}/raw")
            refresh.refresh(spark, f"{root}/raw", *dims, f"{root}/out")
        _file_builds[key] = root
    return _file_builds[key]
