"""Products with a thin side, on rows as dense vectors (k, data).

A result that is thin on both sides sums outer products: a task adds its rows up to one small matrix, so what is
exchanged depends on the number of tasks and the width, not on the number of rows. A tall matrix times a small one is
multiplied where its rows are, without an exchange. No cells are joined in either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THIN = 512  # columns of a thin matrix: a task holds at most THIN x THIN numbers of a result
AT_ONCE = 1 << 20  # cells of rows that are multiplied together


def of_cells(cells: DataFrame, width: int) -> DataFrame:
    """Rows of at most THIN cells as vectors; a cell that is missing is 0."""
    sorted_row = F.array_sort(F.collect_list(F.struct("j", "v")))
    rows = cells.groupBy(F.col("i").alias("k")).agg(sorted_row.alias("row"))
    value = lambda j: F.coalesce(F.get(F.filter("row", lambda x: x["j"] == j), 0)["v"], F.lit(0))
    full = F.size("row") == width
    return rows.select("k", F.when(full, F.transform("row", lambda x: x["v"])).otherwise(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value)).alias("data"))


def dense(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows x width; what a short vector lacks is 0, null is not a number."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right; integers are exact or raise."""
    if left.dtype.kind == "i" and (np.abs(left.astype(float)) @ np.abs(right.astype(float)) >= 2.0**63 * (1 - 1e-9)).any():
        raise OverflowError("a sum of products of integers leaves 64 bits")
    return left @ right


def _outer(batches: Iterator[pa.RecordBatch], rows: int, cols: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(a[, b]) -> cells of the sum of a's outer products with b (or with itself)."""
    total, seen = np.zeros((rows, cols), kind), False
    for batch in batches:
        step = max(1, AT_ONCE // max(rows, cols, 1))
        for lo in range(0, batch.num_rows, step):
            some = batch.slice(lo, step)
            a = dense(some.column(0), rows, kind)
            part = _exact(a.T, a if some.num_columns == 1 else dense(some.column(1), cols, kind))
            if kind == "int64" and (np.abs(total.astype(float)) + np.abs(part.astype(float)) >= 2.0**63 * (1 - 1e-9)).any():
                raise OverflowError("a sum of products of integers leaves 64 bits")
            total, seen = total + part, True
    if seen:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])


def inner(left: DataFrame, right: DataFrame | None, rows: int, cols: int, kind: str) -> DataFrame:
    """Cells of left.T @ right (right None: left.T @ left), both as vectors over the same long index; kind: bigint or double."""
    if right is None:
        both = left.select(F.col("data").alias("a"))
    else:
        both = left.select("k", F.col("data").alias("a")).join(right.select("k", F.col("data").alias("b")), "k").select("a", "b")
    numpy = "int64" if kind == "bigint" else "float64"
    part = both.mapInArrow(lambda b: _outer(b, rows, cols, numpy), f"i long, j long, v {kind}")
    return part.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _times(batches: Iterator[pa.RecordBatch], small: np.ndarray) -> Iterator[pa.RecordBatch]:
    width, cols = small.shape
    for batch in batches:
        step = max(1, AT_ONCE // max(width, cols, 1))
        for lo in range(0, batch.num_rows, step):
            some = batch.slice(lo, step)
            out = _exact(dense(some.column(1), width, small.dtype.name), small)
            k = np.repeat(some.column(0).to_numpy(), cols)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.tile(np.arange(cols), some.num_rows)), pa.array(out.ravel())], ["i", "j", "v"])


def times(left: DataFrame, small: np.ndarray) -> DataFrame:
    """Cells of left @ small, for vectors of a tall matrix and a small one that tasks hold."""
    kind = "bigint" if small.dtype.kind == "i" else "double"
    return left.select("k", "data").mapInArrow(lambda b: _times(b, small), f"i long, j long, v {kind}")


def collected(cells: DataFrame, rows: int, cols: int, kind: str) -> np.ndarray:
    """A small matrix (at most THIN x THIN) as an array."""
    out = np.zeros((rows, cols), kind)
    table = cells.toArrow()
    v = table.column("v").cast(pa.int64() if kind == "int64" else pa.float64()).to_numpy()
    out[table.column("i").to_numpy(), table.column("j").to_numpy()] = v
    return out
