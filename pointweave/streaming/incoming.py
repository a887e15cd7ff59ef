"""New cloud files as a stream: one record per file, parsed statelessly, resumed by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.sources.formats import SCHEMA, _read


def incoming_clouds(spark: SparkSession, root: str, pattern: str = "*.{pcd,ply,npy}", per_trigger: int = 64) -> DataFrame:
    """Streaming (path, point_id, x, y, z) of files that arrive under ``root``."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(root)
    )
    return files.select("path", "content").mapInPandas(_read, SCHEMA)


def process_incoming(stream: DataFrame, handle, checkpoint: str, available_now: bool = True):
    """Run ``handle(batch_df, batch_id)`` on every micro-batch; finished files are never handled again."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
