"""Exact stack distances: how many other tiles are touched between two accesses to a tile, without simulating a cache.

Let accesses be numbered 0, 1, ..., and before(t) be the number of the last access to t's tile, -1 for the first. Of the
accesses s < t those with before(s) < before(t) are all up to before(t) itself, and of those in between exactly the first
ones of each tile. So the distance of t is the number of s < t with before(s) < before(t), less before(t) + 1.

These pairs are counted in blocks: inside a block of BLOCK accesses directly; between the blocks of a node of FAN blocks,
and then of FAN nodes, and so on, by passing over the node's rows in the order of before() with a counter for each child.
A node's rows lie in as many ranges as Spark makes of them; counts of the ranges before are small tables. No task
holds the log, and nothing depends on how often a tile occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cache_stats import accesses, miss_curve, previous
from gridloom.sources.shared import materialise, ordered_index

BLOCK, FAN = 2_048, 64
AT_ONCE = 16_384  # rows of a range that are counted together
ROWS = "t long, seq long, tile long, before long, seen long"


def _with_seen(table: pa.Table, more: np.ndarray) -> pa.Table:
    columns = {f.split()[0]: table.column(f.split()[0]) for f in ROWS.split(", ")}
    return pa.table(columns | {"seen": pa.array(table.column("seen").to_numpy() + more)})


def _inside(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs within one block."""
    table = table.sort_by("t")
    before = table.column("before").to_numpy()
    more = np.array([np.count_nonzero(before[:k] < b) for k, b in enumerate(before)], np.int64)
    return _with_seen(table, more)


def _between(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of earlier and later children within one range of a node, and those with the ranges before it (base)."""
    table = table.sort_by([("before", "ascending"), ("t", "ascending")])
    child, base = table.column("child").to_numpy(), table.column("base")[0].as_py()
    counts, more = np.array(base, np.int64), np.zeros(len(table), np.int64)
    for lo in range(0, len(child), AT_ONCE):
        own = child[lo : lo + AT_ONCE]
        each = np.zeros((len(own) + 1, len(counts)), np.int64)
        each[np.arange(1, len(own) + 1), own] = 1
        running = counts + np.cumsum(each, axis=0)
        earlier = np.cumsum(running[:-1], axis=1)
        more[lo : lo + AT_ONCE] = np.where(own > 0, earlier[np.arange(len(own)), own - 1], 0)
        counts = running[-1]
    return _with_seen(table, more)


def _level(rows: DataFrame, size: int) -> DataFrame:
    """rows with the pairs that lie in one node of FAN children of `size` accesses each, but in different children."""
    node, child = F.expr(f"t div {size * FAN}"), F.expr(f"cast((t div {size}) % {FAN} as int)")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("node", node).withColumn("child", child).repartitionByRange(parts, "node", "before", "t")
    dealt = materialise(placed.withColumn("range", F.spark_partition_id()), "level")
    counted = dealt.groupBy("node", "range").agg(*(F.count_if(F.col("child") == c).alias(f"n{c}") for c in range(FAN)))
    earlier = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("node", "range", F.array(*(F.coalesce(F.sum(f"n{c}").over(earlier), F.lit(0)) for c in range(FAN))).alias("base"))
    return dealt.join(base, ["node", "range"]).groupBy("node", "range").applyInArrow(_between, ROWS)


def stack_distances(log: DataFrame) -> DataFrame:
    """seq, tile, depth: the number of distinct other tiles since the tile's last access, for all accesses but first ones."""
    numbered = ordered_index(accesses(log).select(F.col("seq").alias("at"), "tile"), "rank", ["at"])
    ranked = materialise(numbered.select((F.col("rank") - 1).alias("seq"), "at", "tile"), "ranked")
    found = previous(ranked, F.col("tile")).select(F.col("seq").alias("t"), F.col("at").alias("seq"), F.col("tile").cast("long").alias("tile"), F.coalesce("before", F.lit(-1)).cast("long").alias("before"), F.lit(0).cast("long").alias("seen"))
    n = ranked.count()
    rows = found.groupBy(F.expr(f"t div {BLOCK}")).applyInArrow(_inside, ROWS)
    size = BLOCK
    while size < n:
        rows = _level(rows, size)
        size *= FAN
    return rows.where("before >= 0").select("seq", "tile", (F.col("seen") - F.col("before") - 1).alias("depth"))


def exact_miss_curve(distances: DataFrame, step: int = 16, steps: int = 32) -> DataFrame:
    """cache_size, miss_rate: the share of repeated accesses that a cache of so many tiles, dropping the least recently used, would miss."""
    return miss_curve(distances.select((F.col("depth") + 1).alias("distance")), step, steps)
