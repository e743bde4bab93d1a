"""Image files as image tables, by suffix; and image tables as files."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.operators import pixel
from stillwater.sources import tiff

SCHEMA = "path string, h int, w int, data array<double>"


def decode(path: str, raw: bytes) -> np.ndarray:
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".npy":
        image = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float64)
    elif suffix in (".tif", ".tiff"):
        image = tiff.decode(raw)
    else:
        raise ValueError(f"unsupported image suffix {suffix!r}")
    if image.ndim != 2 or not np.isfinite(image).all():
        raise ValueError(f"{path} is not a finite two-dimensional image")
    return image


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """path, h, w, data of every file; unknown suffixes and unsound images fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            got = [decode(p, c) for p, c in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "h": [g.shape[0] for g in got], "w": [g.shape[1] for g in got], "data": [g.ravel() for g in got]})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, SCHEMA)


def pixels(arrays: DataFrame, *keys: str) -> DataFrame:
    return pixel.exploded(arrays, keys or ("path",), "data", F.col("w"))


def save(arrays: DataFrame, folder: str, name: str = "path") -> list[str]:
    """Writes each image of a table of arrays as 16-bit TIFF on the driver, one at a time. An export for viewing; tables are kept as Parquet."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in arrays.select(name, "h", "w", "data").toLocalIterator():
        out.append(os.path.join(folder, f"{os.path.splitext(os.path.basename(str(row[0])))[0]}.tif"))
        with open(out[-1], "wb") as f:
            f.write(tiff.encode(np.array(row["data"], float).reshape(row["h"], row["w"])))
    return out
