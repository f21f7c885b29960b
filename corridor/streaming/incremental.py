"""T1 as a file-arrival stream: new yearly flow files update their year partitions.

The product rebuilds its fact from one raw file per year. As a Structured
Streaming job, each new file is picked up by the file source, run through the
same ``build_flows`` plan inside ``foreachBatch``, and written with dynamic
partition overwrite. A batch only says that something arrived: the change set of
the folder (``plans/refresh``) names the affected years and the files that hold
rows of them, and each such year is rebuilt from those files alone. The result
does not depend on how files fall into batches; a replayed batch finds nothing
changed, or rewrites the same rows.

Contract: a year's rows may come in any number of files, which add up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.refresh import MANIFEST, changes, rebuilt
from ..schemas import RAW_FLOWS
from ..sinks.clustering import write_clustered
from ..sinks.files import folder_files, get_text, put_text


def flow_updates(spark: SparkSession, raw_dir: str, sections: DataFrame, country_codes: DataFrame,
                 covered: DataFrame, out_path: str, checkpoint: str, files_per_batch: int = 4,
                 available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops.

    The manifests lie beside the fact, in ``<out_path>-manifest``.
    """
    state = f"{out_path.rstrip('/')}-manifest"
    raw = (
        spark.readStream.schema(RAW_FLOWS)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(raw_dir)
    )

    def upsert(batch: DataFrame, batch_id: int) -> None:
        last = spark.read.schema(MANIFEST).parquet(f"{state}/{get_text(spark, f'{state}/CURRENT')}") if folder_files(spark, state, "CURRENT") else None
        now = f"manifest-{uuid.uuid4().hex}"
        found = changes(spark, raw_dir, last, f"{state}/{now}")
        if found.paths:
            write_clustered(rebuilt(spark, found, sections, country_codes, covered), out_path, covered, mode="overwrite", partitions="dynamic")
        put_text(spark, f"{state}/CURRENT", now)

    writer = raw.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
