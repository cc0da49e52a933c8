"""The array API: lazy two-dimensional matrices on Spark.

    import gridloom.api as gl
    c = (gl.array(spark, [[1, 2], [3, 4]]) + gl.ones(spark, (2, 2))) * 2
    c.to_numpy()
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cells as ops
from gridloom.operators.vectors import THIN
from gridloom.plans import dtypes
from gridloom.plans.cost import estimate
from gridloom.plans.logical import Add, Leaf, MatMul, Node, Scale, Transpose
from gridloom.plans.lower import lower, method, natural
from gridloom.plans.rules import matched, multiplications, nesting, pattern, rewrite
from gridloom.sources.shared import materialise

#: Elements that to_numpy() brings to the driver, at most.
NUMPY_LIMIT = 50_000_000

#: Columns of a band and rows of a strip: made cells come band by band, and a task makes at most a strip of a band, or as many cells.
STRIP, BAND = 65_536, 512

#: Tasks that make cells, at most.
MAKERS = 100_000


class Matrix:
    """A lazy dense matrix: shape and dtype are known, cells are computed by an action."""

    ndim = 2

    def __init__(self, node: Node):
        if min(node.shape) < 0:
            raise ValueError("a shape has no negative numbers")
        self.node = node

    @classmethod
    def from_vectors(cls, table: DataFrame, rows: int, cols: int, dtype: str) -> Matrix:
        """From rows (k, data): the k-th row as an array of cols values. Thin products read them without an exchange."""
        cells = table.select(F.col("k").alias("i"), F.posexplode("data").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast(dtypes.spark_type(dtype)).alias("v"))
        return cls(Leaf(cells, rows, cols, dtypes.dtype_name(dtype), table.select("k", "data")))

    @classmethod
    def from_cells(cls, cells: DataFrame, rows: int, cols: int, dtype: str | None = None) -> Matrix:
        """From rows (i, j, v), unique and complete; dtype is that of v unless given."""
        return cls(Leaf(cells, rows, cols, dtypes.dtype_name(dtype or dtypes.of_spark(dict(cells.dtypes)["v"]))))

    @property
    def shape(self) -> tuple[int, int]:
        return self.node.shape

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.node.dtype)

    @property
    def size(self) -> int:
        return self.shape[0] * self.shape[1]

    @property
    def T(self) -> Matrix:
        return Matrix(Transpose(self.node))

    @property
    def cells(self) -> DataFrame:
        """(i, j, v), lazily."""
        return lower(self.node)

    def __repr__(self) -> str:
        return f"Matrix(shape={self.shape}, dtype={self.node.dtype})"

    def __add__(self, other) -> Matrix:
        if isinstance(other, (int, float, np.number)):
            raise NotImplementedError("adding a scalar is not part of the array API; use plus()")
        if not isinstance(other, Matrix):
            raise TypeError(f"can't add {type(other).__name__} to a matrix")
        return Matrix(Add(self.node, other.node))

    def __sub__(self, other) -> Matrix:
        if not isinstance(other, Matrix):
            raise TypeError(f"can't subtract {type(other).__name__} from a matrix")
        return Matrix(Add(self.node, other.node, -1))

    def __mul__(self, other) -> Matrix:
        if isinstance(other, np.number):
            other = other.item()
        if not isinstance(other, (int, float)):
            raise NotImplementedError("matrices are multiplied by numbers only; use @ for products, hadamard() for elements")
        return Matrix(Scale(self.node, other))

    __rmul__ = __mul__

    def __neg__(self) -> Matrix:
        return self * -1

    def __truediv__(self, other) -> Matrix:
        if not isinstance(other, (int, float, np.number)):
            raise NotImplementedError("matrices are divided by numbers only")
        return self * (1.0 / float(other))

    def __matmul__(self, other) -> Matrix:
        if not isinstance(other, Matrix):
            raise TypeError(f"can't multiply a matrix by {type(other).__name__}")
        return Matrix(MatMul(self.node, other.node))

    # Beyond the array API: elementwise operations, reductions, rectangles.

    def _each(self, value: Column, dtype: str) -> Matrix:
        kind = dtypes.spark_type(dtype)
        return Matrix(Leaf(self.cells.select("i", "j", value.cast(kind).alias("v")), *self.shape, dtype))

    def plus(self, scalar: float) -> Matrix:
        """A number added to every element."""
        return self._each(F.col("v") + F.lit(scalar), dtypes.scaled(self.node.dtype, scalar))

    def hadamard(self, other: Matrix) -> Matrix:
        """The product element by element."""
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} don't match")
        dtype = dtypes.product(self.node.dtype, other.node.dtype)
        kind = dtypes.spark_type(dtype)
        right = other.cells.select("i", "j", F.col("v").cast(kind).alias("w"))
        joined = self.cells.select("i", "j", F.col("v").cast(kind).alias("v")).join(right, ["i", "j"])
        return Matrix(Leaf(joined.select("i", "j", (F.col("v") * F.col("w")).alias("v")), *self.shape, dtype))

    def tile(self, row: int, col: int, rows: int, cols: int) -> Matrix:
        """A rectangle, renumbered from 0 and cut off at the edge; empty beyond it."""
        height, width = max(0, min(rows, self.shape[0] - row)), max(0, min(cols, self.shape[1] - col))
        part = ops.tile(self.cells, row, col, height, width).select((F.col("i") - row).alias("i"), (F.col("j") - col).alias("j"), "v")
        return Matrix(Leaf(part, height, width, self.node.dtype))

    def reduce(self, how: str, axis: int | None = None) -> DataFrame:
        return ops.reduce(self.cells, how, axis)

    def correlation(self) -> Matrix:
        """Pearson correlation between the columns: the product of the standardised matrix with itself, by cells or by blocks as any other product. Columns without variance correlate as null."""
        rows = natural(rewrite(self.node)) if self.shape[1] <= THIN else None
        z = Leaf(ops.standardised(self.cells), *self.shape, "float64", None if rows is None else ops.standardised_vectors(rows, self.cells))
        total = lower(MatMul(Transpose(z), z))
        share = total.select("i", "j", (F.nanvl("v", F.lit(None)) / self.shape[0]).alias("v"))
        return Matrix(Leaf(share, self.shape[1], self.shape[1], "float64"))

    # Actions.

    def compute(self, path: str | None = None) -> Matrix:
        """Compute once: into path (Parquet with its description) or into the shared folder."""
        from gridloom.sources.files import load, save

        if path is not None:
            save(path, self)
            return load(self.cells.sparkSession, path)
        return Matrix(Leaf(materialise(self.cells, "matrix"), *self.shape, self.node.dtype))

    def to_numpy(self) -> np.ndarray:
        """The whole matrix on the driver; for small ones."""
        if self.size > NUMPY_LIMIT:
            raise ValueError(f"{self.size} elements are too many for the driver; use compute() or cells")
        out = np.zeros(self.shape, self.dtype)
        table = self.cells.toArrow()
        out[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("v").to_numpy()
        return out

    def report(self) -> dict:
        """What would run, without running it: the rewritten tree's root, its one-pass pattern (match: with what it is made from), its estimated cost; of a product also the order of its chain, how it is computed and how many cells are multiplied."""
        node = rewrite(self.node)
        out = {"shape": self.shape, "dtype": self.node.dtype, "root": type(node).__name__, "pattern": pattern(node), "match": matched(node), "cost": estimate(node)}
        return out | ({"order": nesting(node), "method": method(node), "multiplications": multiplications(node)} if isinstance(node, MatMul) else {})


def _grid(spark: SparkSession, shape: tuple[int, int], value: Column, dtype) -> Matrix:
    """A value for each place. Bands of at most BAND columns come one after the other, each row by row, in full waves of tasks of bounded size: few
    different i and j come together, each i in runs and the js again and again (in multiples of 8, as Parquet packs them), so whatever writes the
    cells writes small columns. A place takes two divisions by literals, and neither index can be null."""
    rows, cols = (int(x) for x in shape)
    if min(rows, cols) < 0:
        raise ValueError("a shape has no negative numbers")
    if rows * cols == 0:
        places = spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("j"))
    else:
        width = -(-cols // -(-cols // BAND))
        if cols > BAND:
            width = min(BAND, -(-width // 8) * 8)
        bands = -(-cols // width)
        size = rows * bands * width
        wave = spark.sparkContext.defaultParallelism
        tasks = wave * -(-min(-(-size // (STRIP * BAND)), MAKERS) // wave)
        places = spark.range(0, size, 1, tasks).select("id", _part("id", width).alias("line"))
        places = places.select("id", "line", _part("line", rows).alias("band"))
        places = places.select((F.col("line") - F.col("band") * rows).alias("i"), (F.col("band") * width + F.col("id") - F.col("line") * width).alias("j"))
        if bands * width > cols:
            places = places.where(F.col("j") < cols)
    return Matrix(Leaf(places.select("i", "j", value.cast(dtypes.spark_type(dtype)).alias("v")), rows, cols, dtypes.dtype_name(dtype)))


def _part(column: str, by: int) -> Column:
    """How often a positive literal goes into a column; Spark calls every division nullable, this is not."""
    return F.coalesce(F.expr(f"{column} div {by}"), F.lit(0).cast("long"))


def array(spark: SparkSession, data, dtype="float32") -> Matrix:
    """From a two-dimensional array-like on the driver."""
    found = np.asarray(data, dtype=dtypes.dtype_name(dtype))
    if found.ndim != 2:
        raise ValueError(f"a matrix has two dimensions, not {found.ndim}")
    import pyarrow as pa

    i, j = np.indices(found.shape)
    table = pa.table({"i": i.ravel().astype("int64"), "j": j.ravel().astype("int64"), "v": found.ravel()})
    return Matrix.from_cells(spark.createDataFrame(table), *found.shape, dtype)


def ndarray(spark: SparkSession, data=None, filepath: str | None = None, shape: tuple[int, int] | None = None, dtype="float32") -> Matrix:
    """From an array-like, from a raw or native file (a raw one needs its shape), or of zeros if only a shape is given."""
    if filepath is not None:
        from gridloom.sources import files

        return files.load(spark, filepath, shape, dtype)
    if data is not None:
        found = array(spark, data, dtype)
        if shape is not None and tuple(shape) != found.shape:
            raise ValueError(f"the data have the shape {found.shape}, not {tuple(shape)}")
        return found
    if shape is None:
        raise ValueError("give data, a file or a shape")
    return zeros(spark, shape, dtype)


def full(spark: SparkSession, shape: tuple[int, int], value: float, dtype="float32") -> Matrix:
    return _grid(spark, shape, F.lit(value), dtype)


def zeros(spark: SparkSession, shape: tuple[int, int], dtype="float32") -> Matrix:
    return full(spark, shape, 0, dtype)


def ones(spark: SparkSession, shape: tuple[int, int], dtype="float32") -> Matrix:
    return full(spark, shape, 1, dtype)


def eye(spark: SparkSession, n: int, dtype="float32") -> Matrix:
    return _grid(spark, (n, n), F.when(F.col("i") == F.col("j"), 1).otherwise(0), dtype)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the place alone: the same in any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def random_rand(spark: SparkSession, shape: tuple[int, int], dtype="float32", seed: int = 0) -> Matrix:
    """Uniform in [0, 1), reproducible; 24 bits, so that float32 never rounds up to 1."""
    value = F.floor(uniform(seed, F.col("i"), F.col("j")) * (1 << 24)) / F.lit(float(1 << 24))
    return _grid(spark, shape, value, dtype)


def dot(a: Matrix, b: Matrix) -> Matrix:
    return a @ b


def add(a: Matrix, b: Matrix) -> Matrix:
    return a + b


def multiply(a: Matrix, scalar: float) -> Matrix:
    return a * scalar
