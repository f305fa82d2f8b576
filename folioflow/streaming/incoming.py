"""Optional extension: documents that arrive as files are processed as a stream, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "id bigint, raw_text string, rfc_hint string, fecha_hint string, file_path string, file_hash string, arrived timestamp"


def incoming(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Rows of JSON files in a folder; a hash that comes again within the delay is dropped."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["file_hash"])


def run(rows: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; a batch that is repeated after a failure replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
