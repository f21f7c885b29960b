"""Run the queries of one report page at the same time, as the page does (Q6, Q7, K7).

Each DataFrame is an independent Spark job submitted from its own driver
thread; a scheduler pool name lets a FAIR-scheduled cluster share executors
between concurrent reports. Results are report-sized (bounded by partners x
categories x years), which is what a page displays.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row


def fetch_all(spark, report: dict[str, DataFrame], pool: str | None = None,
              max_workers: int = 3, max_rows: int = 1_000_000) -> dict[str, list[Row]]:
    """Collect every result of a report concurrently; keys starting with ``_`` are skipped.

    A frame of more than ``max_rows`` rows is no report and raises instead of filling the driver.
    """
    items = {k: v for k, v in report.items() if not k.startswith("_")}

    def run(df: DataFrame) -> list[Row]:
        if pool is not None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        return rows

    with ThreadPoolExecutor(max_workers=max_workers) as ex:
        futures = {k: ex.submit(run, df) for k, df in items.items()}
        return {k: f.result() for k, f in futures.items()}
