"""Extension: a mean stack kept up to date while frames arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "case_id string, frame int, y int, x int, v double"


def frames(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of frames from Parquet files as they are added."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_stack(stream: DataFrame) -> DataFrame:
    """Mean and number of the frames seen so far at each pixel: state grows with pixels, not with frames."""
    return stream.groupBy("case_id", "y", "x").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n_frames"))


def start(stack: DataFrame, folder: str, checkpoint: str, once: bool = False):
    """Writes each update as a batch of Parquet named by its epoch, so that a repeated epoch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    writer = stack.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
