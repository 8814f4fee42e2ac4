"""Maps that grow with a stream: sums and counts by pixel are additive, so that batches can be summed when the map is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_map(samples: DataFrame) -> DataFrame:
    """(ipix, hits, val) of a streaming sample table; write it in update or complete mode."""
    return samples.groupBy("ipix").agg(F.count("*").alias("hits"), F.sum("dat").alias("val"))


def write_batches(samples: DataFrame, at: str, checkpoint: str) -> StreamingQuery:
    """Each batch's map in a folder of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        streaming_map(batch).write.mode("overwrite").parquet(f"{at}/batch={number}")

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_map(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(at).groupBy("ipix").agg(F.sum("hits").alias("hits"), F.sum("val").alias("val"))


def event_pixels(events: DataFrame) -> DataFrame:
    return events.select(((F.col("event_id") * 7 % 32) * 24 + F.col("user_id") * 13 % 24).alias("ipix"), F.col("value").alias("dat"))
