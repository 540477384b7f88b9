"""Continuous ingestion of structure files: an extension, the reference has no streams.

Files of a watched folder are parsed as they come and appended to a table unless their contents are there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from porelake.sources.cif import parse_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_structures(spark: SparkSession, folder: str, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query. Contents are told apart by checksum, within a batch and against the table; a batch that is repeated adds nothing."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.cif").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        parsed = parse_files(batch).dropDuplicates(["checksum", "block_idx"])
        try:
            known = spark.read.parquet(table_path).select("checksum").distinct()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            parsed = parsed.join(known, "checksum", "left_anti")
        parsed.write.mode("append").parquet(table_path)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
