"""Incremental evaluation: new result lines are taken up as they arrive, each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def watch(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON lines of a folder, with the time of the file for the watermark."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return df.withColumn("_arrived", F.col("_metadata.file_modification_time"))


def once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First row of each key; state older than ``late`` is forgotten, so it does not grow for ever."""
    return stream.withWatermark("_arrived", late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet exactly once for each batch: a batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(stream: DataFrame, by: str = "difficulty") -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
