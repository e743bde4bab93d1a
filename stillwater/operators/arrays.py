"""Images as one row each (keys, h, w, ``data``: row-major array), worked on in NumPy a batch at a time: no pixel is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.operators.pixel import imploded

Keys = Sequence[str]
AT_ONCE = 1 << 18  # values of a stack that are worked on together, an image at least


def images(table: DataFrame, keys: Keys, data: str, width: int | Column) -> DataFrame:
    """Row-major arrays as images; a last line that is not full ends in nulls, and an image without pixels is none."""
    w, n = F.lit(width) if isinstance(width, int) else width, F.size(data)
    h = F.ceil(n / w).cast("int")
    lacking = F.array_repeat(F.lit(None).cast("double"), h * w - n)
    full = F.when(n == h * w, F.col(data).cast("array<double>")).otherwise(F.concat(F.col(data).cast("array<double>"), lacking))
    return table.filter(n > 0).select(*keys, h.alias("h"), w.cast("int").alias("w"), full.alias("data"))


def pixels(rows: DataFrame, keys: Keys, names: Keys = ("v",)) -> DataFrame:
    """keys, y, x and the names, one pixel a row, of arrays with their width ``w``."""
    rows = rows.select(*keys, "w", F.posexplode(F.arrays_zip(*names)).alias("p", "s"))
    return rows.select(*keys, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), *(F.col("s")[n].alias(n) for n in names))


def joined(reference: DataFrame, other: DataFrame, keys: Keys) -> DataFrame:
    """keys, h, w, data, ref: images beside the reference's pixels (of equal size) as a second array."""
    shared = [k for k in keys if k in reference.columns]
    return other.join(imploded(reference, shared).select(*shared, "h", "w", F.col("data").alias("ref")), [*shared, "h", "w"])


def stacks(batch: pa.RecordBatch, sources: Keys) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Rows of equal size: themselves, their stacks (n, h, w) with nulls as NaN, and which have nulls."""
    size = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "w")], 1)
    for h, w in np.unique(size, axis=0):
        at = np.flatnonzero((size == (h, w)).all(1))
        step = max(1, AT_ONCE // int(h * w))
        for i in range(0, len(at), step):
            part = batch.take(pa.array(at[i : i + step]))
            flat = [part.column(s).flatten() for s in sources]
            holes = np.zeros(len(part), bool)
            for f in flat:
                if f.null_count:
                    holes |= f.is_null().to_numpy(zero_copy_only=False).reshape(len(part), -1).any(1)
            yield part, [f.to_numpy(zero_copy_only=False).reshape(len(part), h, w) for f in flat], holes


def mapped(rows: DataFrame, keys: Keys, kernel: Callable[..., dict[str, np.ndarray]], names: Keys = ("v",), sources: Keys = ("data",), scalars: str = "") -> DataFrame:
    """keys, h, w and an array a name: ``kernel(stack, ...) -> {name: stack}``, one stack of images of equal size a source.

    With ``scalars`` (a schema) the kernel returns a number an image and name instead. NaN is null for images with nulls.
    """
    typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    schema = ", ".join([*typed, scalars] if scalars else [*typed, "h int", "w int", *(f"{n} array<double>" for n in names)])

    def run(batches):
        for batch in batches:
            for part, given, holes in stacks(batch, sources):
                out, n = kernel(*given), len(part)
                columns = {k: part.column(k) for k in keys}
                if not scalars:
                    h, w = out[names[0]].shape[1:]
                    columns |= {"h": pa.array(np.full(n, h, "int32")), "w": pa.array(np.full(n, w, "int32"))}
                for name, a in out.items():
                    flat = np.ascontiguousarray(a).ravel()
                    lost = np.isnan(flat) & np.repeat(holes, len(flat) // n) if holes.any() else None
                    flat = pa.array(flat, mask=lost)
                    columns[name] = flat if scalars else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * (len(flat) // n)), flat)
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select(*keys, "h", "w", *sources).mapInArrow(run, schema)
