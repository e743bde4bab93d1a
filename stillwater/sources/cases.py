"""Benchmark cases as partitioned Parquet: inputs and truth in separate tables, so that a method is never shown the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.operators import pixel

PARTS = ("frames", "latent", "warp", "component")


def save(folder: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """frames (case_id, frame, y, x, v), latent, warp and component tables, partitioned by case."""
    unknown = set(tables) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    for name, df in tables.items():
        if name == "frames":
            df = df.withColumn("v", pixel.quantised(pixel.clipped(F.col("v"))))
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{folder}/{'input' if name == 'frames' else 'truth'}/{name}")


def frames(spark: SparkSession, folder: str, case_id: str | None = None, frame: int | None = None) -> DataFrame:
    """The input of all cases, or of one, or one frame of it (from 1): both filters prune what is read."""
    df = spark.read.parquet(f"{folder}/input/frames")
    df = df if case_id is None else df.filter(F.col("case_id") == case_id)
    return df if frame is None else df.filter(F.col("frame") == frame)


def truth(spark: SparkSession, folder: str, name: str, case_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/truth/{name}")
    return df if case_id is None else df.filter(F.col("case_id") == case_id)


def import_observation(folder: str, arrays: DataFrame, case_id: str) -> None:
    """Real frames (path, h, w, data) as a case without truth; they must have one shape. Frames are numbered by path."""
    shapes = arrays.select("h", "w").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("an observation has one frame at least, and all have one shape")
    ordinal = arrays.select("path").distinct().withColumn("frame", F.dense_rank().over(Window.orderBy("path")).cast("int"))  # one row a frame
    rows = pixel.exploded(arrays.join(ordinal, "path"), ("frame",), "data", F.col("w")).withColumn("case_id", F.lit(case_id))
    save(folder, frames=rows)
