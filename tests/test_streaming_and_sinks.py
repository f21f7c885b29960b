"""Incremental ETL stream and the file sinks."""

from __future__ import annotations

import pytest

from corridor.operators.normalize import build_flows
from corridor.schemas import RAW_FLOWS
from corridor.sinks.files import export_result, materialize, write_dimensions, write_flows
from corridor.streaming.incremental import flow_updates


def _inputs(spark):
    sections = spark.createDataFrame([("X", ["01"]), ("Y", ["02"])], "category string, chapters array<string>")
    codes = spark.createDataFrame([(1, "A", "a", "AAA"), (2, "B", "b", "BBB")],
                                  "country_code int, country_name string, country_iso2 string, country_iso3 string")
    covered = spark.createDataFrame([("A", []), ("B", [])], "country string, groups array<string>")
    return sections, codes, covered


def _write_year(d, year, rows):
    p = d / f"flows_{year}.csv"
    p.write_text("t,i,j,k,v,q\n" + "".join(f"{year},{i},{j},{k},{v},1\n" for i, j, k, v in rows))


def test_stream_updates_year_partitions(spark, tmp_path):
    sections, codes, covered = _inputs(spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    out, ck = str(tmp_path / "flows"), str(tmp_path / "ck")
    _write_year(raw, 2002, [(1, 2, "010000", 1500.0), (2, 1, "020000", 250.0)])
    q = flow_updates(spark, str(raw), sections, codes, covered, out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2

    _write_year(raw, 2003, [(1, 2, "010000", 10.0), (1, 2, "010101", 5.0)])
    q = flow_updates(spark, str(raw), sections, codes, covered, out, ck)
    q.awaitTermination(120)
    got = sorted((r.year, r.exporter, r.importer, r.category, float(r.value))
                 for r in spark.read.parquet(out).collect())
    assert got == [(2002, "A", "B", "X", 1.5), (2002, "B", "A", "Y", 0.25), (2003, "A", "B", "X", 0.02)]

    # the stream agrees with the batch job over the same files
    batch = build_flows(spark.read.schema(RAW_FLOWS).option("header", True).csv(str(raw)), sections, codes, covered)
    assert sorted(tuple(r) for r in batch.select("year", "exporter", "importer", "category", "value").collect()) == \
        sorted(tuple(r) for r in spark.read.parquet(out).select("year", "exporter", "importer", "category",
                                                                 "value").collect())


@pytest.mark.parametrize("files_per_batch", [1, 4])
def test_stream_does_not_depend_on_batches(spark, tmp_path, files_per_batch):
    sections, codes, covered = _inputs(spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, v in enumerate((1000.0, 2000.0)):
        (raw / f"part{k}.csv").write_text(f"t,i,j,k,v,q\n2002,1,2,010000,{v},1\n")
    q = flow_updates(spark, str(raw), sections, codes, covered, str(tmp_path / "flows"), str(tmp_path / "ck"), files_per_batch=files_per_batch)
    q.awaitTermination(120)
    assert [float(r.value) for r in spark.read.parquet(str(tmp_path / "flows")).collect()] == [3.0]
    (raw / "bad.csv").write_text("t,i,j,k,v,q\n2002,1,2,010000,oops,1\n")
    with pytest.raises(Exception):
        flow_updates(spark, str(raw), sections, codes, covered, str(tmp_path / "flows"), str(tmp_path / "ck")).awaitTermination(120)


def test_materialize_writes_once_and_reuses(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    a = materialize(spark, df, path)
    b = materialize(spark, spark.range(100), path)  # finished copy exists: reused, not rewritten
    assert a.count() == 5 and b.count() == 5


def test_write_flows_is_partitioned_by_year(spark, tmp_path, micro):
    path = str(tmp_path / "flows")
    write_flows(micro.flows, path)
    back = spark.read.parquet(path)
    assert sorted(p.name for p in (tmp_path / "flows").iterdir() if p.name.startswith("year=")) == [
        "year=2002", "year=2003"]
    assert back.count() == micro.flows.count()


def test_exports_and_dimension_files(spark, tmp_path, micro):
    from corridor.operators.membership import group_members

    p = export_result(micro.flows, str(tmp_path), "trade_with_a_2002_2003", fmt="csv")
    assert spark.read.option("header", True).csv(p).count() == micro.flows.count()
    cats = spark.createDataFrame([(c,) for c in micro.categories], "category string")
    write_dimensions(spark.createDataFrame([(2002, 2003)], "y0 int, y1 int"), cats,
                     group_members(micro.membership), str(tmp_path / "dims"))
    assert spark.read.json(str(tmp_path / "dims/group_membership")).count() == 5


def test_materialize_replaces_a_partial_copy(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()  # as if a copy stopped half way
    assert materialize(spark, spark.range(7), str(path)).count() == 7
