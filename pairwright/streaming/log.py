"""Structured Streaming extensions: an append-only verdict log that writes each id once, and windowed counts with late data. Verdicts
have no event time of their own; these are extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.sources.files import append_new


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of a table that stands in a folder as ``name``.parquet, be that one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A plain path has to be a folder for a stream; a pattern may match a file or a folder.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def append_log(stream: DataFrame, path: str, checkpoint: str, key: str = "result_id") -> None:
    """Drain what is there: each batch appends the ids that the log does not hold, each once. No watermark, so late rows are not lost; a batch that
    is run again after a failure adds nothing twice."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, path, key)).start().awaitTermination()


def windowed_counts(stream: DataFrame, path: str, checkpoint: str, by: str, time: str = "ts", width: str = "1 hour", delay: str = "1 day") -> None:
    """Counts by window and key, the whole result in each batch."""
    counts = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
    counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
