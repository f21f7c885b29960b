"""Writers: typed Parquet, header CSV, dimension exports, result exports."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..params import ALL_CATEGORIES, ALL_COUNTERPARTS, Params


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_states(spark: SparkSession, path: str) -> list[str]:
    """Path, length and modification time of a file or of the files of a folder, sorted."""
    fs, p = _fs(spark, path)
    return sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p))


def folder_files(spark: SparkSession, path: str, prefix: str = "", folders: bool = False) -> list:
    """(name, length, modification time) of a folder's files, without hidden ones; ``folders``: the names of its folders."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s for s in fs.listStatus(p) if s.isDirectory() == folders and s.getPath().getName().startswith(prefix) and s.getPath().getName()[0] not in "._"]
    return sorted(s.getPath().getName() if folders else (s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file: written aside and renamed into place."""
    fs, dst = _fs(spark, path)
    _, src = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(src, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(dst):
        fs.delete(dst, False)
    if not fs.rename(src, dst):
        raise IOError(f"could not write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    """The content of a small text file."""
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    """A completed Spark write: the directory carries the ``_SUCCESS`` marker."""
    fs, p = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(p))


def write_flows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long fact as snappy Parquet partitioned by year, sorted by exporter (K1).

    Range partitioning on (year, exporter) gives each task a contiguous key
    range, so files are few per year and their row groups carry tight
    exporter min/max statistics that reporter filters skip on.
    """
    (
        df.repartitionByRange("year", "exporter")
        .sortWithinPartitions("year", "exporter", "importer", "category")
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy("year")
        .parquet(path)
    )


def write_wide(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Wide view (one DECIMAL(18,2) column per category) as snappy Parquet by year (K1)."""
    (
        df.repartitionByRange("year", "exporter")
        .sortWithinPartitions("year", "exporter", "importer")
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy("year")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Small dimension or result table: Parquet, or CSV with a header (K2)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.option("compression", "snappy").parquet(path)


def materialize(spark: SparkSession, df: DataFrame, path: str, writer=write_table) -> DataFrame:
    """Write ``df`` once and read it back; reuse a finished copy when present.

    The write goes to a unique sibling and is renamed into place, so readers
    never see a half-written table and concurrent builders do not clash. The
    returned DataFrame reads the files: its lineage is cut.
    """
    if not exists(spark, path):
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        writer(df, tmp)
        fs, dst = _fs(spark, path)
        _, src = _fs(spark, tmp)
        if not exists(spark, path):
            if fs.exists(dst):  # a partial copy without the success marker (non-atomic store): replace it
                fs.delete(dst, True)
            fs.mkdirs(dst.getParent())
            if not fs.rename(src, dst) and not exists(spark, path):
                raise IOError(f"could not move {tmp} to {path}")
        if fs.exists(src):  # another builder won the race
            fs.delete(src, True)
    return spark.read.parquet(path)


def write_dimensions(time_range: DataFrame, categories: DataFrame, group_members: DataFrame, path: str,
                     mode: str = "overwrite") -> None:
    """Consumer-facing dimension exports: year range, sorted categories, group -> sorted members (K4)."""
    write_table(time_range, f"{path}/time_range", "json", mode)
    write_table(categories.orderBy("category"), f"{path}/categories", "json", mode)
    write_table(group_members.orderBy("group_name"), f"{path}/group_membership", "json", mode)


def file_name(query: str, p: Params) -> str:
    """Name of a result: the query and every parameter that can change it, so that results never share a name (K6).

    Readable parts first, made safe for files; a short hash of the whole request tells apart what they blur.
    """
    parts = [query, p.country, *p.partners, p.group if p.group != ALL_COUNTERPARTS else "", p.category if p.category != ALL_CATEGORIES else "",
             p.flow, p.unit if p.is_gdp else f"{p.unit}_{p.prices}", str(p.years[0]) if p.years[0] == p.years[1] else f"{p.years[0]}_{p.years[1]}"]
    safe = [re.sub(r"[^\w.-]+", "_", x.lower()).strip("_") for x in parts if x]
    return "-".join(x for x in safe if x)[:150] + "-" + hashlib.blake2b(repr((query, p)).encode(), digest_size=4).hexdigest()


def export_result(df: DataFrame, directory: str, name: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Write a query result under ``directory/name``; an older result is never overwritten unless asked (K5)."""
    path = f"{directory.rstrip('/')}/{name}"
    write_table(df, path, fmt, mode)
    return path


__all__ = ["exists", "write_flows", "write_wide", "write_table", "materialize", "write_dimensions", "file_name",
           "export_result"]
