"""How many distinct tiles windows of a log hold: exact means for many lengths at once, and sketches of intervals that can be united."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cache_stats import accesses, previous

LENGTHS = tuple(1 << k for k in range(41))
PRECISION = 12  # of the sketches: 2 ** 12 registers, an error of about 1.6 %
WIDE = "decimal(38,0)"  # sums of gaps go up to tiles x events


def gaps(log: DataFrame) -> DataFrame:
    """gap, last: for each tile the runs of events without an access to it, those before its first and after its last access included. last is 1 for the latter, of which each tile has one, else 0."""
    hits = accesses(log)
    size = log.agg(F.max("seq").alias("end"))
    inside = previous(hits.select("seq", "tile"), F.col("tile")).select(F.coalesce(F.col("seq") - F.col("before") - 1, F.col("seq")).alias("gap"), F.lit(0).alias("last"))
    after = hits.groupBy("tile").agg(F.max("seq").alias("seq")).join(F.broadcast(size)).select((F.col("end") - F.col("seq")).alias("gap"), F.lit(1).alias("last"))
    return inside.union(after)


def mean_tiles(log: DataFrame, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """length, windows, mean_tiles: the mean number of distinct tiles that windows of so many consecutive events access.

    A tile is missing from a window that lies in one of its gaps: a gap of g events holds g - length + 1 windows. Gaps are
    counted by the longest of the lengths that they hold, in one aggregate; the curve adds up those counts from the
    longest, a row for each length. Lengths above the log's have no windows and no row; an empty log has none at all.
    """
    sizes = sorted(set(lengths))
    if not sizes or sizes[0] < 1:
        raise ValueError("lengths are positive")
    spark = log.sparkSession
    grid = F.array(*(F.lit(x).cast("long") for x in sizes))
    holds = F.size(F.filter(grid, lambda x: x <= F.col("gap"))).alias("holds")
    counts = gaps(log).groupBy(holds).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gap").cast(WIDE)).alias("events"), F.sum("last").alias("tiles"))
    every = spark.range(1).select(F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grid)).alias("holds", "length"))
    filled = every.join(counts, "holds", "left").fillna(0, ["n", "tiles"]).withColumn("events", F.coalesce("events", F.lit(0).cast(WIDE)))
    longer, all_rows = Window.orderBy("holds").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    summed = filled.select("holds", "length", F.sum("n").over(longer).alias("n"), F.sum("events").over(longer).alias("events"), F.sum("tiles").over(all_rows).alias("tiles"))
    windows = F.col("end") + 2 - F.col("length")
    absent = (F.col("events") - (F.col("length") - 1).cast(WIDE) * F.col("n").cast(WIDE)).cast("double")
    curve = summed.where("holds > 0").join(F.broadcast(log.agg(F.max("seq").alias("end")))).where(windows > 0)
    return curve.select("length", windows.alias("windows"), (F.col("tiles") - absent / windows).alias("mean_tiles"))


def interval_sketches(log: DataFrame, length: int) -> DataFrame:
    """interval (0, 1, ...), sketch: HyperLogLog sketches of the tiles accessed in each run of so many events. Their size is fixed, so they can be kept instead of the log; intervals without an access have no row."""
    return accesses(log).groupBy(F.floor(F.col("seq") / length).alias("interval")).agg(F.hll_sketch_agg("tile", PRECISION).alias("sketch"))


def sketched_tiles(sketches: DataFrame, together: int = 1) -> DataFrame:
    """interval, n_tiles: about how many distinct tiles each run of `together` intervals accesses, from the sketches alone."""
    return sketches.groupBy(F.floor(F.col("interval") / together).alias("interval")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_tiles"))
