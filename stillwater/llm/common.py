"""What the operators of this subpackage share: reading columns, cutting lineage, mapping whole texts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker is used again, and what it keeps is missing from the JVM beside it."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and forget its lineage.

    ``spark.checkpoint.dir`` names that folder; only where it is unset, on a local master (tests), one is made here.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stillwater-checkpoint-"))
    return df.checkpoint(eager=True)


def settled(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """``cut``, and then read as no more partitions than its counted rows need: few rows make few files and tasks."""
    done = cut(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def forget(spark: SparkSession) -> None:
    """Have Spark remove shuffle files and checkpoints that nothing refers to any more: it notices when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch holding about ``most`` bytes of text (one row at least)."""
    start, held = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, most: int = 8_000_000) -> DataFrame:
    """Apply ``make()(slice)`` to slices of ``rows`` (doc_id, text, ...). ``make`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 1, most):
                yield work(part)

    return rows.mapInArrow(tidy(run), schema)


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


#: Identifiers are broadcast up to this many; beyond, rows are joined by shuffling.
BROADCAST_IDS = 1_000_000


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose identifier is in ``ids`` (one column, counted before it is broadcast); nulls match nulls."""
    named = cut(ids.toDF("__id"))
    small = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    return docs.join(small, docs[id_col].eqNullSafe(small["__id"]), "left_semi")


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text ``make()(texts)`` keeps, all columns as they are. ``make`` runs once a task."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at, 4_000_000):
                yield part.filter(pa.array(work([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
