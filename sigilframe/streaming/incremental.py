"""Files that arrive: new icons go through feature extraction once, whatever restarts happen. The reference jobs are batches; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigilframe.functions.text import icon_id
from sigilframe.operators.raster import extract, split_failures


def feature_stream(spark: SparkSession, folder: str, output: str, failures: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder of PNG files and appends features and failures of files whose icon_id the output lacks."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png").load(folder)

    def step(batch: DataFrame, _: int) -> None:
        from sigilframe.sources.tables import exists

        rows = batch.select(icon_id("path").alias("icon_id"), "content")
        if exists(spark, output):
            rows = rows.join(spark.read.parquet(output).select("icon_id"), "icon_id", "left_anti")
        done, failed = split_failures(extract(rows))
        done.write.mode("append").parquet(output)
        failed.write.mode("append").parquet(failures)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
