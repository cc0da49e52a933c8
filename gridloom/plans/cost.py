"""What a computation would read and do, in tiles, and in which order it would touch them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.logical import Node
from gridloom.plans.rules import pattern

TILE = 1024


def tiles(shape: tuple[int, int], tile: int = TILE) -> int:
    return -(-shape[0] // tile) * -(-shape[1] // tile)


def _leaves(node: Node) -> list[Node]:
    return [node] if not node.inputs else [x for n in node.inputs for x in _leaves(n)]


def estimate(node: Node) -> dict[str, float]:
    """Tiles read and computed, bytes, the share that a tile cache saves, and the total (a read counts a hundredfold). One-pass patterns read each input once; else the result is read and written."""
    if pattern(node):
        shapes = [n.shape for n in _leaves(node)]
        io = compute = sum(map(tiles, shapes))
        size, benefit = sum(r * c * 4 for r, c in shapes), 0.3
    else:
        compute = tiles(node.shape)
        io, size, benefit = 2 * compute, node.rows * node.cols * 8, 0.0
    return {"io_ops": io, "compute_ops": compute, "memory_bytes": size, "cache_benefit": benefit, "total": 100 * io + compute}


def _axis(spark: SparkSession, n: int, tile: int, name: str) -> DataFrame:
    return spark.range(-(-n // tile)).select((F.col("id") * tile).alias(name))


def tile_grid(spark: SparkSession, rows: int, cols: int, tile: int = TILE) -> DataFrame:
    """(r, c) of every tile."""
    across = -(-cols // tile)
    return spark.range(tiles((rows, cols), tile)).select((F.expr(f"id div {across}") * tile).alias("r"), (F.col("id") % across * tile).alias("c"))


def elementwise_accesses(spark: SparkSession, rows: int, cols: int, names: list[str], tile: int = TILE) -> DataFrame:
    """(pos, matrix, r, c): tile after tile, one access to each named matrix."""
    across, n = -(-cols // tile), len(names)
    pos = spark.range(tiles((rows, cols), tile) * n).withColumn("t", F.expr(f"id div {n}"))
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    return pos.select(F.col("id").alias("pos"), name.alias("matrix"), (F.expr(f"t div {across}") * tile).alias("r"), (F.col("t") % across * tile).alias("c"))


def product_accesses(spark: SparkSession, rows: int, inner: int, cols: int, left: str = "A", right: str = "B", tile: int = TILE) -> DataFrame:
    """(pos, matrix, r, c) of a product: for each tile of the result, along the inner dimension, a tile of the left and one of the right."""
    ks, cs = -(-inner // tile), -(-cols // tile)
    pos = spark.range(2 * -(-rows // tile) * cs * ks).selectExpr("id as pos", "id % 2 as side", f"(id div 2) % {ks} * {tile} as k", f"(id div {2 * ks}) % {cs} * {tile} as col", f"(id div {2 * ks * cs}) * {tile} as row")
    return pos.select("pos", F.when(F.col("side") == 0, left).otherwise(right).alias("matrix"), F.when(F.col("side") == 0, F.col("row")).otherwise(F.col("k")).alias("r"), F.when(F.col("side") == 0, F.col("k")).otherwise(F.col("col")).alias("c"))
