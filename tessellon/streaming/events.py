"""Extensions beyond batch: windows over event streams, with the same logic for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of a table's files. Streams read folders: a table of one file is read as that file of its folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:
        rows = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = "30 minutes") -> DataFrame:
    """Count and sum of values by tumbling window and type. In streams, events later than `late` are left out; None leaves the
    stream's own watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    sums = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Each event_id once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
