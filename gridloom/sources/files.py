"""Reading, writing, converting and checking matrix files.

The native form is Parquet cells in Morton order with a JSON description beside it. Raw row-major files and .npy go
through the data source of rawfile.py; CSV and TSV are read in parallel; HDF5 needs h5py.
"""

from __future__ import annotations

import functools
import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.api import Matrix
from gridloom.plans import dtypes
from gridloom.plans.logical import Leaf, Transpose
from gridloom.sources import rawfile
from gridloom.sources.shared import file_index

FORMATS = {".npy": "npy", ".h5": "hdf5", ".hdf5": "hdf5", ".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".dat": "binary", ".bin": "binary"}
ROWS_AT_ONCE = 1000
SIDE = 256  # of the tiles of the native form
FILE_CELLS = 1 << 24  # of a file of it: 256 tiles
CELLS = "i long, j long, v {}"


def detect_format(path: str) -> str:
    """By the ending, whatever its case; raw binary if it is unknown."""
    return FORMATS.get(os.path.splitext(path)[1].lower(), "binary")


def _spaced(n: Column) -> Column:
    """The lowest 31 bits of n with a gap before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(i: Column, j: Column, side: int = SIDE) -> Column:
    """The tile of a cell on the Morton curve: tiles that are near in both directions are near in this order."""
    at = lambda x: F.floor(x / side).cast("long")
    return F.shiftleft(_spaced(at(i)), 1).bitwiseOR(_spaced(at(j)))


class InvalidMatrix(ValueError):
    """A matrix whose cells are not complete, unique and finite; counts says what was found."""

    def __init__(self, path: str, counts: dict[str, int]):
        super().__init__(f"{path} is not valid: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
        self.counts = counts


def save(path: str, matrix: Matrix, side: int = SIDE, cells_per_file: int = FILE_CELLS) -> dict[str, int]:
    """Parquet cells and their description; returns the counts of problems(), gathered by the tasks that write.

    Files hold runs of tiles in Morton order, so that ranges of i, of j or of both skip files (and pages in them) by their
    statistics. A run's length follows from the shape, so no sample of the cells is drawn and they are computed once. The
    counts are in the description, too.
    """
    spark = matrix.cells.sparkSession
    rows, cols = matrix.shape
    share = -(-rows * cols // (4 * spark.sparkContext.defaultParallelism))
    run = max(1, min(cells_per_file, share) // side**2)
    tiles = matrix.cells.withColumn("_tile", morton(F.col("i"), F.col("j"), side)).withColumn("_run", F.floor(F.col("_tile") / run))
    # Dealt by runs and ordered inside tiles: the window needs no exchange of its own, and equal places follow each other.
    line = Window.partitionBy("_run", "_tile").orderBy("i", "j")
    ordered = tiles.repartition("_run").withColumn("_again", (F.lag("i").over(line) == F.col("i")) & (F.lag("j").over(line) == F.col("j")))
    v, seen = F.col("v").cast("double"), Observation()
    inside = F.col("i").between(0, rows - 1) & F.col("j").between(0, cols - 1)
    tests = {"repeated": F.col("_again"), "outside": ~inside, "nulls": v.isNull(), "nans": F.isnan(v), "infinite": F.abs(v) == float("inf")}
    watched = ordered.observe(seen, F.count(F.lit(1)).alias("n_cells"), *(F.count_if(test).alias(f"n_{name}") for name, test in tests.items()))
    watched.drop("_tile", "_run", "_again").write.mode("overwrite").option("maxRecordsPerFile", run * side**2).parquet(f"{path}/cells")
    counts = {"n_cells": seen.get["n_cells"], "n_expected": rows * cols} | {f"n_{name}": seen.get[f"n_{name}"] for name in tests}
    meta = json.dumps({"rows": rows, "cols": cols, "dtype": matrix.node.dtype, "layout": "cells", "order": "morton", "side": side, "dense": True, "found": counts})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return counts


def described(spark: SparkSession, path: str) -> dict:
    """The description of a matrix in the native form; found has the counts of its problems when it was written."""
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def load(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, dtype="float32") -> Matrix:
    """A saved matrix by its description; with a shape, a raw row-major file."""
    if shape is not None:
        return load_raw(spark, path, shape, dtype)
    try:
        meta = described(spark, path)
    except Exception as e:
        raise ValueError(f"{path} has no description; a raw file needs a shape") from e
    return Matrix(Leaf(spark.read.parquet(f"{path}/cells"), meta["rows"], meta["cols"], meta["dtype"]))


def load_raw(spark: SparkSession, path: str, shape: tuple[int, int], dtype="float32") -> Matrix:
    """A headerless row-major file, or a folder of such files in name order. It must hold exactly rows x cols elements. Filters on i choose what is read."""
    rows, cols = shape
    name = dtypes.dtype_name(dtype)
    return Matrix(Leaf(rawfile.read(spark, path, shape, name, name), rows, cols, name))


def _rows(matrix: Matrix) -> DataFrame:
    """(i, row): the cells of each row in order."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"])
    return matrix.cells.groupBy("i").agg(row.alias("row"))


def save_raw(path: str, matrix: Matrix) -> None:
    """A folder of raw row-major parts named by their first row, on any file system that Arrow knows; in name order they are the matrix. All or nothing."""
    rawfile.write(_rows(matrix), path, matrix.shape, np.dtype(matrix.dtype).name, "parts")


def save_file(path: str, matrix: Matrix) -> None:
    """One headerless row-major file (or .npy, by the ending) in a folder that all machines mount. All or nothing."""
    header, name = b"", np.dtype(matrix.dtype)
    if path.lower().endswith(".npy"):
        np.lib.format.write_array_header_1_0(own := io.BytesIO(), {"descr": np.lib.format.dtype_to_descr(name), "fortran_order": False, "shape": matrix.shape})
        header = own.getvalue()
    rawfile.write(_rows(matrix), path, matrix.shape, name.name, "file", header)


def load_npy(spark: SparkSession, path: str, dtype=None) -> Matrix:
    """A two-dimensional .npy file in either order of its elements; tasks read ranges of rows (of columns, if it is stored by columns)."""
    fs, place = rawfile.filesystem(path)
    with fs.open_input_file(place) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, found = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        head = f.tell()
    if len(shape) != 2:
        raise ValueError(f"a matrix has two dimensions, not {len(shape)}")
    name = dtypes.dtype_name(dtype or found)
    stored = shape[::-1] if by_columns else shape
    leaf = Leaf(rawfile.read(spark, path, stored, found.str, name, head), *stored, name)
    return Matrix(Transpose(leaf) if by_columns else leaf)


def load_delimited(spark: SparkSession, path: str, sep: str, dtype="float32") -> Matrix:
    """All-numeric text without a header, one matrix row a line; empty lines don't count. Lines of different lengths are refused."""
    name = dtypes.dtype_name(dtype)
    lines = file_index(spark.read.text(path).where(F.trim("value") != ""), "i").select("i", F.split("value", sep).alias("all"))
    rows, least, most = lines.agg(F.max("i"), F.min(F.size("all")), F.max(F.size("all"))).first()
    if least != most:
        raise ValueError(f"{path} has lines of {least} and of {most} values")
    cells = lines.select("i", F.posexplode("all").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.trim("v").cast(dtypes.spark_type(name)).alias("v"))
    return Matrix(Leaf(cells, 0 if rows is None else rows + 1, most or 0, name))


def load_hdf5(spark: SparkSession, path: str, dataset: str | None = None, dtype="float32") -> Matrix:
    """A named dataset, or the file's first. Needs h5py on all machines."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the package h5py") from e
    with h5py.File(path) as f:
        key = dataset or next(iter(f.keys()))
        if len(f[key].shape) != 2:
            raise ValueError(f"a matrix has two dimensions; {key} has {len(f[key].shape)}")
        rows, cols = f[key].shape
    name = dtypes.dtype_name(dtype)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with h5py.File(path) as source:
            for batch in batches:
                for chunk in batch.column(0).to_pylist():
                    part = np.asarray(source[key][chunk * ROWS_AT_ONCE : (chunk + 1) * ROWS_AT_ONCE], name)
                    i, j = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + chunk * ROWS_AT_ONCE), pa.array(j.ravel()), pa.array(part.ravel())], ["i", "j", "v"])

    return Matrix(Leaf(spark.range(-(-rows // ROWS_AT_ONCE)).mapInArrow(read, CELLS.format(dtypes.spark_type(name))), rows, cols, name))


def convert(spark: SparkSession, source: str, target: str, format: str | None = None, shape: tuple[int, int] | None = None, dtype="float32", dataset: str | None = None, check: bool = False) -> tuple[str, tuple[int, int]]:
    """Any readable file to the native form; returns the path and the shape. With check, InvalidMatrix is raised if what was written is not complete, unique and finite; the counts come from the job that writes, and the target stays for inspection."""
    kind = format or detect_format(source)
    if kind == "npy":
        matrix = load_npy(spark, source, dtype)
    elif kind in ("csv", "tsv"):
        matrix = load_delimited(spark, source, "," if kind == "csv" else "\t", dtype)
    elif kind == "hdf5":
        matrix = load_hdf5(spark, source, dataset, dtype)
    elif kind == "binary":
        if shape is None:
            raise ValueError("a raw binary file needs a shape")
        matrix = load_raw(spark, source, shape, dtype)
    else:
        raise ValueError(f"unknown format {kind}")
    counts = save(target, matrix)
    if check and not clean(counts):
        raise InvalidMatrix(target, counts)
    return target, matrix.shape


def problems(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: how many cells there are and should be, and how many are out of range, repeated, null, NaN or infinite."""
    v = F.col("v").cast("double")
    inside = F.col("i").between(0, rows - 1) & F.col("j").between(0, cols - 1)
    by_place = cells.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(inside, 0).otherwise(1)).alias("outside"), F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.isnan(v), 1).otherwise(0)).alias("nans"), F.sum(F.when(F.abs(v) == float("inf"), 1).otherwise(0)).alias("infinite"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_place.agg(total("n").alias("n_cells"), F.lit(rows * cols).cast("long").alias("n_expected"), total(F.col("n") - 1).alias("n_repeated"), *(total(c).alias(f"n_{c}") for c in ("outside", "nulls", "nans", "infinite")))


def clean(counts: dict[str, int]) -> bool:
    """Whether counts of problems() name none."""
    return counts["n_cells"] == counts["n_expected"] and not any(counts[c] for c in ("n_repeated", "n_outside", "n_nulls", "n_nans", "n_infinite"))


def valid(matrix: Matrix) -> bool:
    """Complete, unique and finite."""
    return clean(problems(matrix.cells, *matrix.shape).first().asDict())


def sample_tiles(rows: int, cols: int, tiles: int = 10, side: int = SIDE, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """(first row, first column, height, width) of tiles that need not be aligned, the same for a seed and a shape."""
    rng, height, width = np.random.default_rng([seed, rows, cols]), min(side, rows), min(side, cols)
    return [(int(rng.integers(rows - height + 1)), int(rng.integers(cols - width + 1)), height, width) for _ in range(tiles)] if rows and cols else []


def tile_problems(matrix: Matrix, tiles: list[tuple[int, int, int, int]]) -> DataFrame:
    """row, col, n_cells, n_expected, n_bad (null, NaN or infinite) of each tile: a quick check that reads little of a native or raw file, since the tiles' ranges reach its scan. It doesn't tell a repeated cell from a missing one."""
    places = [F.col("i").between(i, i + h - 1) & F.col("j").between(j, j + w - 1) for i, j, h, w in tiles]
    v = F.col("v").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = functools.reduce(lambda x, y: x | y, places, F.lit(False))
    found = matrix.cells.where(rows).agg(*(F.count_if(p).alias(f"n{k}") for k, p in enumerate(places)), *(F.count_if(p & bad).alias(f"bad{k}") for k, p in enumerate(places)), F.count(F.lit(1)).alias("all"))
    each = [F.struct(*(F.lit(x).cast("long").alias(n) for n, x in (("row", i), ("col", j))), F.col(f"n{k}").alias("n_cells"), F.lit(h * w).cast("long").alias("n_expected"), F.col(f"bad{k}").alias("n_bad")) for k, (i, j, h, w) in enumerate(tiles)]
    return found.select(F.inline(F.array(*each)) if each else F.inline(F.array().cast("array<struct<row:bigint,col:bigint,n_cells:bigint,n_expected:bigint,n_bad:bigint>>")))


def sampled_valid(matrix: Matrix, tiles: int = 10, side: int = SIDE, seed: int = 0) -> bool:
    """Whether a few tiles are complete and finite, for matrices that are too large for valid()."""
    return tile_problems(matrix, sample_tiles(*matrix.shape, tiles, side, seed)).where("n_cells <> n_expected OR n_bad > 0").isEmpty()
