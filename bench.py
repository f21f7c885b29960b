"""Benchmark: headline queries Q1-Q5 and the flow ETL.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is run to
completion through the no-op sink (every row computed, nothing collected).
One warm-up round runs every job once (JIT, file listing, broadcast code
paths); then each job runs ``$BENCH_REPS`` timed times in a row and the
reported time is their median.
The serving tables are built once before timing; T1 times that build on its
own, writing the partitioned fact to a fresh folder each run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corridor.params import Params  # noqa: E402
from corridor.plans import multi, single  # noqa: E402
from corridor.plans.catalog import fixture_catalog, fixture_flows  # noqa: E402
from corridor.session import local_session, shared_dir  # noqa: E402
from corridor.sinks.files import write_flows  # noqa: E402

YEARS = (1995, 2001)
GROUPS = ("BLOC_A", "BLOC_B", "AFRICA")


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "5"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    t0 = time.time()
    cat = fixture_catalog(spark, sf_dir)
    setup = time.time() - t0
    scratch = f"{shared_dir(spark)}/corridor/bench-{uuid.uuid4().hex[:8]}"

    jobs = {
        "q1_top_partners": lambda: _run(single.top_partners(
            cat, Params("EUROPE", YEARS, unit="usd", flow="exports"))),
        "q2_top_categories": lambda: _run(single.top_categories(
            cat, Params("BLOC_A", YEARS, unit="cad", prices="constant", flow="imports"))),
        "q3_world_trade": lambda: _run(single.world_trade(cat, Params("EUROPE", YEARS, unit="gdp"))),
        "q4_partner_series": lambda: _run(multi.partner_series(
            cat, Params("NATION_8", YEARS, unit="eur", prices="constant", partners=GROUPS))),
        "q5_partner_matrix": lambda: _run(multi.partner_matrix(
            cat, Params("NATION_8", YEARS, unit="gdp", partners=GROUPS))),
        "t1_build_flows": lambda: write_flows(fixture_flows(spark, sf_dir), f"{scratch}/{uuid.uuid4().hex[:8]}"),
    }
    for job in jobs.values():  # warm-up round
        job()
    runs: dict[str, list[float]] = {name: [] for name in jobs}
    for name, job in jobs.items():
        for _ in range(reps):
            t = time.perf_counter()
            job()
            runs[name].append(time.perf_counter() - t)
    times = {name: round(statistics.median(r), 4) for name, r in runs.items()}
    print(json.dumps({
        "metric": "median_sec_sum_q1_q5_t1",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
        "reps": reps,
        "setup_sec": round(setup, 2),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
