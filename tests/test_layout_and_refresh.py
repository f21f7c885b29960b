"""Clustering on both ends, change-set rebuilds, and rejects in the ETL's own pass."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corridor.operators import rejects
from corridor.operators.normalize import build_flows
from corridor.operators.quality import etl_audit
from corridor.plans import refresh
from corridor.schemas import RAW_FLOWS
from corridor.sinks.clustering import clustered, dense_codes, interleaved, write_clustered
from corridor.sinks.files import write_flows

from .test_streaming_and_sinks import _inputs


def rows_read(spark, path, condition) -> int:
    """Rows that the Parquet reader hands on for a filter, after pages were skipped."""
    df = spark.read.parquet(path).where(condition).select("value")
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def grid(spark):
    """Every pair of 64 countries in 12 categories and two years."""
    names = spark.range(64).select(F.format_string("C%03d", "id").alias("country"))
    ends = spark.range(64 * 64 * 12 * 2).select(
        (F.col("id") % 2 + 2002).cast("int").alias("year"), F.format_string("C%03d", (F.col("id") / 2).cast("long") % 64).alias("exporter"),
        F.format_string("C%03d", (F.col("id") / 128).cast("long") % 64).alias("importer"),
        F.concat(F.lit("S"), ((F.col("id") / 8192).cast("long")).cast("string")).alias("category"), F.lit(1).cast("decimal(18,2)").alias("value"))
    return names, ends


def test_filters_on_either_end_skip_pages(spark, tmp_path, grid):
    names, flows = grid
    old, new = str(tmp_path / "by_exporter"), str(tmp_path / "both")
    write_flows(flows, old)
    write_clustered(flows, new, names, page_rows=1000)
    assert sorted(p for p in os.listdir(new) if "=" in p) == ["year=2002", "year=2003"]
    back = spark.read.parquet(new)
    assert back.count() == flows.count() and back.exceptAll(flows.select(back.columns)).count() == 0
    for end in ("importer", "exporter"):
        mine = F.col(end) == "C017"
        exact = flows.where(mine).count()
        assert exact <= rows_read(spark, new, mine) < 0.4 * flows.count()
    importer, either = F.col("importer") == "C017", (F.col("importer") == "C017") | (F.col("exporter") == "C017")
    assert rows_read(spark, new, importer) < 0.5 * rows_read(spark, old, importer)
    assert rows_read(spark, new, either) < 0.5 * rows_read(spark, old, either)
    several = F.col("importer").isin("C003", "C017", "C040")
    assert rows_read(spark, new, several) < 0.8 * rows_read(spark, old, several)


def test_curve_places_follow_both_codes(spark):
    got = spark.range(64).select((F.col("id") % 8).alias("a"), (F.col("id") / 8).cast("long").alias("b")).select("a", "b", interleaved(F.col("a"), F.col("b"), 3).alias("z")).collect()
    for r in got:
        assert r.z == sum(((r.a >> i) & 1) << (2 * i + 1) | ((r.b >> i) & 1) << (2 * i) for i in range(3))
    assert sorted(r.z for r in got) == list(range(64))


def test_clustering_keeps_every_row(spark):
    """Unknown and null ends, repeated names, one name alone, no rows."""
    flows = spark.createDataFrame([(2002, "A", "B", "X", Decimal("1.00")), (2002, "Q", "B", "X", Decimal("2.00")), (2002, None, "A", "X", None)] * 3,
                                  "year int, exporter string, importer string, category string, value decimal(18,2)")
    for names in ([("A",), ("B",), ("A",), (None,)], [("A",)], []):
        codes = dense_codes(spark.createDataFrame(names, "country string"), "country")
        assert sorted(map(str, clustered(flows, codes).collect())) == sorted(map(str, flows.collect()))
    assert clustered(flows.limit(0), codes).count() == 0


# ---- change sets ------------------------------------------------------------------

def put(folder, name, rows):
    (folder / name).write_text("t,i,j,k,v,q\n" + "".join(f"{t},{i},{j},{k},{v},1\n" for t, i, j, k, v in rows))


def state_of(root):
    """Every file of the fact with its time of change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root / "flows") for f in fs if f.endswith(".parquet")}


def published(spark, root):
    return sorted((r.year, r.exporter, r.importer, r.category, float(r.value)) for r in refresh.load_flows(spark, str(root)).collect())


def whole(spark, raw, dims):
    df = build_flows(spark.read.schema(RAW_FLOWS).option("header", True).csv(str(raw)), *dims)
    return sorted((r.year, r.exporter, r.importer, r.category, float(r.value)) for r in df.collect())


def test_refresh_rebuilds_only_touched_years(spark, tmp_path):
    dims, raw, out = _inputs(spark), tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    put(raw, "flows 2002+a.csv", [(2002, 1, 2, "010000", 1500.0), (2002, 2, 1, "020000", 250.0)])
    put(raw, "flows_2003.csv", [(2003, 1, 2, "010000", 10.0)])
    put(raw, "mixed.csv", [(2003, 2, 1, "010000", 7.0), (2004, 2, 1, "020101", 9.0)])

    def go(version=""):
        years = refresh.refresh(spark, str(raw), *dims, str(out), version)
        assert published(spark, out) == whole(spark, raw, dims)
        return years

    assert go() == [2002, 2003, 2004]
    first = state_of(out)
    assert go() == [] and state_of(out) == first, "nothing changed, nothing written"
    # one more file: its years are rebuilt, the others' files stay as they are
    put(raw, "more.csv", [(2004, 1, 2, "010000", 5.0), (2005, 1, 2, "010000", 6.0)])
    assert go() == [2004, 2005]
    second = state_of(out)
    assert all(second[f] == t for f, t in first.items()), "published files are never touched"
    added = {f for f in second if f not in first}
    assert added and all("year=2004" in f or "year=2005" in f for f in added)
    # a changed file touches the years it had and the years it has
    put(raw, "flows_2003.csv", [(2003, 1, 2, "010000", 11.0), (2006, 1, 2, "010000", 1.0)])
    os.utime(raw / "flows_2003.csv", (1, 1_900_000_000))
    assert go() == [2003, 2006]
    # a file that is gone takes its rows along, and a year without rows goes
    (raw / "more.csv").unlink()
    assert go() == [2004, 2005] and 2005 not in {r[0] for r in published(spark, out)}
    manifest = {r.file: (sorted(r.years), r.rows) for r in refresh.manifest(spark, str(out)).collect()}
    assert manifest == {"flows 2002+a.csv": ([2002], 2), "flows_2003.csv": ([2003, 2006], 2), "mixed.csv": ([2003, 2004], 2)}
    assert go("other code list") == [2002, 2003, 2004, 2006]


def test_refresh_of_empty_and_half_done_builds(spark, tmp_path):
    dims, raw, out = _inputs(spark), tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    put(raw, "none.csv", [])
    assert refresh.refresh(spark, str(raw), *dims, str(out)) == [] and published(spark, out) == []
    put(raw, "a.csv", [(2002, 1, 2, "010000", 1000.0)])
    put(raw, "bad.csv", [(2002, 1, 2, "010000", "oops")])
    with pytest.raises(Exception):
        refresh.refresh(spark, str(raw), *dims, str(out))
    assert published(spark, out) == [], "the published state stays until a build is whole"
    put(raw, "bad.csv", [(2002, 1, 2, "010000", 500.0)])
    assert refresh.refresh(spark, str(raw), *dims, str(out)) == [2002]
    assert published(spark, out) == [(2002, "A", "B", "X", 1.5)]
    with pytest.raises(FileNotFoundError):
        refresh.load_flows(spark, str(tmp_path / "nowhere"))


# ---- rejects ----------------------------------------------------------------------

RAW = "t int, i int, j int, k string, v decimal(18,2), q string"


def test_kept_and_rejected_add_up(spark, tmp_path):
    dims = _inputs(spark)
    rows = [(2002, 1, 2, "010000", Decimal("1500.00"), None), (2002, 1, 2, "010101", None, None), (2002, 1, 9, "010000", Decimal("5.00"), None), (2002, 9, 2, "020000", Decimal("7.00"), None),
            (2003, 9, 9, "990000", Decimal("2.00"), None), (2003, 2, 1, None, Decimal("3.00"), None), (None, 1, 2, "010000", Decimal("4.00"), None), (2002, None, 2, "010000", Decimal("6.00"), None)] * 5
    raw = spark.createDataFrame(rows, RAW)
    build = rejects.write_audited(raw, *dims, str(tmp_path / "audited"))
    account = rejects.accounting(build).first()
    assert account == etl_audit(raw, *dims).first()
    assert account.rows_in == len(rows) == account.rows_kept + build.rejects.agg(F.sum("n_rows")).first()[0]
    assert account.value_in == account.value_kept + build.rejects.agg(F.sum("value")).first()[0]
    # the job counted the same while it ran
    assert build.seen["rows_in"] == len(rows) and build.seen["rows_kept"] == account.rows_kept and build.seen["value_in"] == account.value_in
    assert [build.seen[f"rows {r}"] for r in rejects.REASONS] == [account.rows_unmapped, account.rows_bad_exporter, account.rows_bad_importer]
    want = sorted(map(tuple, build_flows(raw, *dims).collect()), key=str)
    assert sorted(map(tuple, build.flows.collect()), key=str) == want and want
    assert {(r.reason, r.year, r.i, r.j, r.chapter, r.n_rows) for r in build.rejects.collect()} == {
        ("uncovered importer", 2002, 1, 9, "01", 5), ("uncovered exporter", 2002, 9, 2, "02", 5), ("uncovered exporter", 2002, None, 2, "01", 5),
        ("unmapped product", 2003, 9, 9, "99", 5), ("unmapped product", 2003, 2, 1, None, 5)}


def test_rejects_come_from_one_scan_and_one_shuffle(spark, tmp_path):
    spark.createDataFrame([(2002, 1, 2, "010000", Decimal("1.00"), None)], RAW).write.parquet(str(tmp_path / "raw"))
    df = rejects.audited(rejects.labelled(spark.read.parquet(str(tmp_path / "raw")), *_inputs(spark)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(reason") == 1


def test_rejects_of_an_empty_table(spark, tmp_path):
    build = rejects.write_audited(spark.createDataFrame([], RAW), *_inputs(spark), str(tmp_path / "audited"))
    assert build.flows.count() == build.rejects.count() == 0 and rejects.accounting(build).first().rows_in == 0
