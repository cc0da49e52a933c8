"""Matrix operators on cells (i, j, v): joins, projections and aggregates that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a side that may be broadcast: a million rows of (long, long, double) are about 40 MB as a relation.
BROADCAST_CELLS = 1_000_000


def add(left: DataFrame, right: DataFrame, kind: str, sign: int = 1) -> DataFrame:
    """Elementwise sum: both sides' cells as one relation, summed by place with a partial sum before the only shuffle. A cell that a side lacks counts as 0, whatever the type; two logical matrices add as "or"."""
    if kind == "boolean":
        return left.unionByName(right).groupBy("i", "j").agg(F.bool_or("v").alias("v"))
    a, b = left.select("i", "j", F.col("v").cast(kind).alias("v")), right.select("i", "j", (sign * F.col("v").cast(kind)).alias("v"))
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").cast(kind).alias("v"))


def doubled(cells: DataFrame, kind: str) -> DataFrame:
    """A matrix plus itself needs no join."""
    return cells.select("i", "j", (F.col("v") + F.col("v")).cast(kind).alias("v"))


def scale(cells: DataFrame, scalar: float, kind: str) -> DataFrame:
    """Products are made in double (or bigint) and rounded once to the element type."""
    wide = "bigint" if kind == "bigint" else "double"
    return cells.select("i", "j", (F.col("v").cast(wide) * F.lit(scalar).cast(wide)).cast(kind).alias("v"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(left: DataFrame, right: DataFrame, kind: str, left_cells: int, right_cells: int) -> DataFrame:
    """Join on the inner index and sum by place: sums are partial before the shuffle. The smaller side is broadcast where its known number of cells allows it, else both are dealt by the inner index."""
    wide = "bigint" if kind == "bigint" else "double"
    a = left.select("i", F.col("j").alias("k"), F.col("v").cast(wide).alias("a"))
    b = right.select(F.col("i").alias("k"), "j", F.col("v").cast(wide).alias("b"))
    if min(left_cells, right_cells) <= BROADCAST_CELLS:
        a, b = (F.broadcast(a), b) if left_cells < right_cells else (a, F.broadcast(b))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).cast(kind).alias("v"))


def tile(cells: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """The cells of a rectangle, at their places in the whole; beyond the edge there are none. Both ranges reach the scan."""
    return cells.where((F.col("i") >= row) & (F.col("i") < row + rows) & (F.col("j") >= col) & (F.col("j") < col + cols))


def _reduce(value: Column, how: str) -> Column:
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](value)


def reduce(cells: DataFrame, how: str, axis: int | None = None) -> DataFrame:
    """sum, mean, min or max over everything (v), down the columns (axis 0: j, v) or along the rows (axis 1: i, v)."""
    value = _reduce(F.col("v"), how).alias("v")
    return cells.agg(value) if axis is None else cells.groupBy("j" if axis == 0 else "i").agg(value)


def standardised_vectors(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """standardised() of a thin matrix whose rows are vectors (k, data): its columns' moments are one row, which goes to every task."""
    moments = cells.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("all"))
    value = F.zip_with("data", "all", lambda x, c: F.when(c["s"] > 0, (x - c["m"]) / c["s"]))
    return vectors.crossJoin(F.broadcast(moments)).select("k", value.alias("data"))


def standardised(cells: DataFrame) -> DataFrame:
    """Each column less its mean, over its deviation; null in columns without variance. The moments are a row a column; Spark picks the join by their size."""
    moments = cells.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return cells.join(moments, "j").select("i", "j", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).alias("v"))
