"""Rebuild of the years that a change of the input files touches.

A manifest lists every raw file with its length, time of change, years and rows. A refresh
lists the folder again; files that the last manifest doesn't hold in the same state, and files
that are gone, name the touched years. Only files new to the manifest are read to learn their
years, only files that hold a touched year are read to rebuild it, and only those years are
written. A build's folder holds the years it wrote; the state that is published names a build for each
year, so the other years' files stay as they are. The pointer moves when all is written, and a reader
sees either state whole. A refresh that stops half way leaves the old state; running it again
does the work again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import build_flows
from ..schemas import FLOWS
from ..sinks.clustering import write_clustered
from ..sinks.files import folder_files, get_text, put_text, write_table
from ..sources.files import read_raw_flows

STATE = "file string, length long, modified long"
MANIFEST = f"{STATE}, years array<int>, rows long"
KEY = ["file", "length", "modified"]


@dataclass
class Changes:
    """What a folder holds now, which years its changes touch, and the files that hold rows of them."""

    manifest: DataFrame
    years: list[int]
    paths: list[str]


def _name_of(path):
    """The plain file name of an input path as Spark reports it (URL-encoded)."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def changes(spark: SparkSession, raw_dir: str, last: DataFrame | None, manifest_path: str) -> Changes:
    """Compare the folder with the ``last`` manifest; the new manifest is written to ``manifest_path``."""
    raw_dir = raw_dir.rstrip("/")
    listed = spark.createDataFrame(folder_files(spark, raw_dir), STATE)
    last = spark.createDataFrame([], MANIFEST) if last is None else last
    fresh = [r.file for r in listed.join(last, KEY, "left_anti").collect()]  # names of files, as a folder listing
    known = listed.join(last, KEY)
    if fresh:
        rows = read_raw_flows(spark, [f"{raw_dir}/{f}" for f in fresh]).select(_name_of(F.input_file_name()).alias("file"), "t")
        per = rows.groupBy("file").agg(F.sort_array(F.collect_set("t")).alias("years"), F.count(F.lit(1)).alias("rows"))
        new = listed.join(last, KEY, "left_anti").join(per, "file", "left").select(
            *KEY, F.coalesce("years", F.array().cast("array<int>")).alias("years"), F.coalesce("rows", F.lit(0)).alias("rows"))
        known = known.unionByName(new)
    write_table(known.select(*KEY, "years", "rows"), manifest_path)
    now = spark.read.schema(MANIFEST).parquet(manifest_path)
    touched = now.join(last, KEY, "left_anti").unionByName(last.join(now, KEY, "left_anti")).select(F.explode("years").alias("y")).distinct()
    years = sorted(r.y for r in touched.collect())
    held = now.where(F.arrays_overlap("years", F.array(*map(F.lit, years)).cast("array<int>"))) if years else now.limit(0)
    return Changes(now, years, sorted(f"{raw_dir}/{r.file}" for r in held.select("file").collect()))


def rebuilt(spark: SparkSession, found: Changes, sections: DataFrame, country_codes: DataFrame, covered: DataFrame) -> DataFrame:
    """The fact rows of the touched years, from the files that hold any."""
    if not found.paths:
        return spark.createDataFrame([], FLOWS)
    raw = read_raw_flows(spark, found.paths)
    return build_flows(raw.where(F.col("t").isin(found.years)), sections, country_codes, covered)


def _state(spark: SparkSession, root: str) -> tuple[str, str, dict[int, str]] | None:
    """(build, version, year -> build that wrote it) of the published state."""
    if not folder_files(spark, root, "CURRENT"):
        return None
    build, version = get_text(spark, f"{root}/CURRENT").split("\n")
    rows = spark.read.schema("year int, build string").json(f"{root}/state/{build}").collect()  # one per year
    return build, version, {r.year: r.build for r in rows}


def refresh(spark: SparkSession, raw_dir: str, sections: DataFrame, country_codes: DataFrame, covered: DataFrame, out_root: str,
            version: str = "") -> list[int]:
    """Bring the fact under ``out_root`` up to date with ``raw_dir``; returns the years that were rebuilt.

    ``version`` names the dimensions (code list, sections, coverage): another one rebuilds every year.
    """
    root, build = out_root.rstrip("/"), f"build-{uuid.uuid4().hex}"
    state = _state(spark, root)
    whole = state is None or state[1] != version
    last = None if whole else spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{state[0]}")
    found = changes(spark, raw_dir, last, f"{root}/manifest/{build}")
    unchanged = not found.years and state is not None and not whole and found.manifest.count() == last.count()
    if unchanged:
        return []
    kept = {} if whole else {y: b for y, b in state[2].items() if y not in found.years}
    if found.paths:
        write_clustered(rebuilt(spark, found, sections, country_codes, covered), f"{root}/flows/build={build}", covered)
        wrote = {int(d.split("=")[1]): build for d in folder_files(spark, f"{root}/flows/build={build}", "year=", folders=True)}
        kept |= wrote
    spark.createDataFrame(sorted(kept.items()), "year int, build string").coalesce(1).write.json(f"{root}/state/{build}")
    put_text(spark, f"{root}/CURRENT", f"{build}\n{version}")
    return found.years


def load_flows(spark: SparkSession, out_root: str) -> DataFrame:
    """The fact as published: the years' folders of the builds that wrote them."""
    root = out_root.rstrip("/")
    state = _state(spark, root)
    if state is None:
        raise FileNotFoundError(f"no build under {root}")
    paths = [f"{root}/flows/build={b}/year={y}" for y, b in sorted(state[2].items())]
    if not paths:
        return spark.createDataFrame([], FLOWS)
    flows = spark.read.option("basePath", f"{root}/flows").parquet(*paths)
    return flows.select(*(F.col(f.name).cast(f.dataType) for f in FLOWS.fields))


def manifest(spark: SparkSession, out_root: str) -> DataFrame:
    """The manifest of the published state."""
    root = out_root.rstrip("/")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{_state(spark, root)[0]}")

