"""Raw raster products as a data source: a window of a row-major file, its rows read in ranges by separate tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stillwater.operators.datasets import SAMPLE_TYPES


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RasterSource(DataSource):
    """Options: path, sample_type, line_samples, offset, row_start, row_stop, col_start, col_stop, rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "y int, x int, v double"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        number = lambda k, default=None: int(options[k] if default is None else options.get(k, default))
        self.path, self.kind = options["path"], np.dtype(SAMPLE_TYPES[options["sample_type"]])
        self.width, self.offset = number("line_samples"), number("offset", 0)
        self.rows, self.cols = (number("row_start"), number("row_stop")), (number("col_start"), number("col_stop"))
        self.step = max(1, number("rows_per_task", 256))

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.step, self.rows[1])) for a in range(self.rows[0], self.rows[1], self.step)]

    def read(self, partition: Rows) -> Iterator[tuple[int, int, float]]:
        size = self.kind.itemsize
        need = (self.cols[1] - self.cols[0]) * size
        with open(self.path, "rb") as f:
            for y in range(partition.first, partition.last):
                f.seek(self.offset + (y * self.width + self.cols[0]) * size, os.SEEK_SET)
                raw = f.read(need)
                if len(raw) != need:
                    raise ValueError(f"{self.path} ends within row {y}")
                for x, v in enumerate(np.frombuffer(raw, self.kind).astype(np.float64).tolist()):
                    yield y - self.rows[0], x, v


def load(spark: SparkSession, path: str, **options):
    """y, x, v of a window; rows and columns count from the window's corner. The file is on storage that all executors mount."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").options(path=path, **{k: str(v) for k, v in options.items()}).load()
