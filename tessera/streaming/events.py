"""Event streams: windowed counts with late data, idempotent inserts, and merged snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, names: str = "*.parquet", files: int = 4) -> DataFrame:
    """The Parquet files of a folder whose names match, as a stream of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): counts and sums by window; works on streams and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into Parquet files, exactly once."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream whose rows replace earlier ones of their key: each batch's changed rows go to a folder of its own.

    A batch that is run again writes its folder anew, so none counts twice. latest() reads the rows that hold.
    """
    run_by_batch(stream, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), "update")


def latest(spark: SparkSession, path: str, schema, *key: str) -> DataFrame:
    """What run_latest() wrote below a path: of each key's rows the last batch's."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    columns = [f.name for f in schema]
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long")
    last = rows.select(*columns, batch.alias("_batch")).groupBy(*key).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
    return last.select("_row.*")


def run_by_batch(stream: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Runs a stream by micro-batches through write(df, batch number), which must be idempotent."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
