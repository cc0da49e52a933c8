"""Analytics of a tile cache's event log, as Spark aggregates and windows that no single task has to hold.

A log has seq (0, 1, ...), ts, event_type (HIT, MISS, EVICT), matrix, r, c, tile and cache_len.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import ordered_index

SAMPLED = 10_000  # events of a sampled timeline, about
BINS = 2_048  # buckets of a round of selection
CHUNK, LEVELS = 4_096, 2  # events whose predecessors are found together; chunks, and chunks of chunks
#: Tiles of a side and of the cache in the usual studies.
SCENARIOS = {"fast_test": (4096, 32), "standard": (8192, 128), "large_analysis": (16384, 256), "eviction_stress": (8192, 32)}


def event_log(events: DataFrame) -> DataFrame:
    """The events table as a log: user_id stands for the tile, the kind of event for what the cache did."""
    numbered = ordered_index(events.select("ts", "event_id", "user_id", "event_type"), "seq", ["ts", "event_id"])
    kind = F.when(F.col("event_type") == "error", "EVICT").when(F.col("event_type") == "signup", "MISS").otherwise("HIT")
    user = F.col("user_id")
    return numbered.select(
        (F.col("seq") - 1).alias("seq"), "ts", kind.alias("event_type"), F.when(user % 2 == 0, "A").otherwise("B").alias("matrix"), (F.floor(user / 16) % 8).alias("r"), (F.floor(user / 2) % 8).alias("c"),
        user.alias("tile"), (F.col("event_id") % 64).alias("cache_len"))


def accesses(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_type").isin("HIT", "MISS"))


def previous(log: DataFrame, key: Column | None = None) -> DataFrame:
    """log with before: the seq of the event before it, of the same key if there is one.

    Each chunk of CHUNK sequence numbers finds its own predecessors. Of each key and chunk the last number goes on to
    chunks of chunks, and so on for LEVELS levels, so that a very common key doesn't end up in one task.
    """
    keyed = log.withColumn("_key", key if key is not None else F.lit(0)).withColumn("_at", F.col("seq"))
    return _before(keyed, LEVELS).drop("_key", "_at")


def _before(rows: DataFrame, levels: int) -> DataFrame:
    """rows with before: the largest seq of the same _key among rows of smaller _at."""
    if not levels:
        return rows.withColumn("before", F.lag("seq").over(Window.partitionBy("_key").orderBy("_at")))
    chunk, far = f"_chunk{levels}", f"_far{levels}"
    chunked = rows.withColumn(chunk, F.floor(F.col("_at") / CHUNK))
    near = chunked.withColumn("_near", F.lag("seq").over(Window.partitionBy("_key", chunk).orderBy("_at")))
    ends = chunked.groupBy("_key", chunk).agg(F.max("seq").alias("seq")).withColumn("_at", F.col(chunk))
    ends = _before(ends, levels - 1).select("_key", chunk, F.col("before").alias(far))
    return near.join(ends, ["_key", chunk]).withColumn("before", F.coalesce("_near", far)).drop(chunk, "_near", far)


def event_counts(log: DataFrame) -> DataFrame:
    """event_type, n, percent of all events."""
    counts = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def sampled(log: DataFrame, most: int = SAMPLED) -> DataFrame:
    """Every n-th event of a long log."""
    return log.where(F.col("seq") % max(1, log.count() // most) == 0)


def timeline(log: DataFrame) -> DataFrame:
    """seq, event_type, tile_rank: tiles numbered from 1 in sorted order."""
    ranks = ordered_index(log.select("tile").distinct(), "tile_rank", ["tile"])
    return log.join(ranks, "tile").select("seq", "event_type", "tile_rank")


def heat_map(log: DataFrame) -> DataFrame:
    """r, c, a_count, b_count, difference of the accesses to each tile."""
    a, b = F.count_if(F.col("matrix") == "A"), F.count_if(F.col("matrix") == "B")
    return accesses(log).groupBy("r", "c").agg(a.alias("a_count"), b.alias("b_count"), (a - b).alias("difference"))


def heat_pyramid(log: DataFrame, levels: int = 4) -> DataFrame:
    """level, r, c, a_count, b_count: heat maps of all resolutions, level k over squares of 2^k x 2^k tiles, by one aggregate with one exchange."""
    places = [(F.shiftright("r", k).alias(f"r{k}"), F.shiftright("c", k).alias(f"c{k}")) for k in range(levels)]
    flat = accesses(log).select("matrix", *(x for pair in places for x in pair))
    sets = [[F.col(f"r{k}"), F.col(f"c{k}")] for k in range(levels)]
    level = F.coalesce(*(F.when(F.grouping(f"r{k}") == 0, k) for k in range(levels)))
    counted = flat.groupingSets(sets, *(x for pair in sets for x in pair)).agg(level.alias("level"), F.count_if(F.col("matrix") == "A").alias("a_count"), F.count_if(F.col("matrix") == "B").alias("b_count"))
    at = lambda x: F.coalesce(*(F.when(F.col("level") == k, F.col(f"{x}{k}")) for k in range(levels)))
    return counted.select("level", at("r").alias("r"), at("c").alias("c"), "a_count", "b_count")


def window_size(n: int) -> int:
    return max(100, n // 50)


def windowed_rates(log: DataFrame, capacity: int, size: int | None = None) -> DataFrame:
    """Tumbling windows of events: n, hit_rate, evict_rate, mean fill."""
    size = size or window_size(log.count())
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    return log.groupBy(F.floor(F.col("seq") / size).alias("window")).agg(F.count(F.lit(1)).alias("n"), share("HIT").alias("hit_rate"), share("EVICT").alias("evict_rate"), (F.avg("cache_len") / capacity).alias("fill"))


def reuse_distances(log: DataFrame) -> DataFrame:
    """seq, tile, distance: events of any kind since the tile's last access."""
    return previous(accesses(log), F.col("tile")).where("before is not null").select("seq", "tile", (F.col("seq") - F.col("before")).alias("distance"))


def distance_histogram(distances: DataFrame, bins: int = 30) -> DataFrame:
    """bin (1 to bins), n: bins of equal width in log10 between the least and the largest distance."""
    ends = distances.agg(F.min(F.log10("distance")).alias("lo"), F.max(F.log10("distance")).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.log10("distance") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0) + 1
    return distances.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def miss_curve(distances: DataFrame, step: int = 16, steps: int = 32) -> DataFrame:
    """cache_size, miss_rate: the share of distances above each size. Distances are counted by the size that they fit first; the curve adds up those counts, a few rows."""
    counts = distances.groupBy(F.least(F.ceil(F.col("distance") / step), F.lit(steps + 1)).alias("fits")).agg(F.count(F.lit(1)).alias("n"))
    sizes = distances.sparkSession.range(1, steps + 2).select(F.col("id").alias("fits"))
    filled = sizes.join(counts, "fits", "left").select("fits", F.coalesce("n", F.lit(0)).alias("n"))
    above = Window.orderBy("fits").rowsBetween(1, Window.unboundedFollowing)
    curve = filled.select("fits", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("more"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return curve.where(F.col("fits") <= steps).select((F.col("fits") * step).alias("cache_size"), F.when(F.col("all") > 0, F.col("more") / F.col("all")).alias("miss_rate"))


def scenario_rates(distances: DataFrame) -> DataFrame:
    """scenario, cache_size, miss_rate: the share of distances above each scenario's cache, in one pass."""
    rates = distances.agg(*(F.avg(F.when(F.col("distance") > tiles, 1.0).otherwise(0.0)).alias(name) for name, (_, tiles) in SCENARIOS.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("scenario"), F.lit(tiles).cast("long").alias("cache_size"), F.col(name).alias("miss_rate")) for name, (_, tiles) in SCENARIOS.items()))
    return rates.select(F.inline(rows))


def eviction_gaps(log: DataFrame) -> DataFrame:
    """seq, gap: events between one eviction and the next."""
    return previous(log.where("event_type = 'EVICT'")).where("before is not null").select("seq", (F.col("seq") - F.col("before")).alias("gap"))


def gap_summary(log: DataFrame) -> DataFrame:
    return eviction_gaps(log).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def order_statistics(df: DataFrame, value: str, place) -> tuple | None:
    """The values at floor(p) and ceil(p) of df in the order of a numeric column, and p = place(number of values); None without values. Nulls and NaN don't count.

    Selection without a sort: each round counts the values of the range that is left in BINS buckets of equal width and
    goes on with the bucket that holds the place, between its least and largest value, until these are one. The driver
    gets BINS rows a round. Whole numbers take log(range) / log(BINS) rounds.
    """
    v = F.col(value)
    some = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(v)
    n, low, high = some.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    if not n:
        return None
    p = place(n)
    k, below, above, count = int(p // 1), 0, None, n
    while low < high:
        width = float(high) / BINS - float(low) / BINS
        bucket = F.least(F.floor((v.cast("double") - float(low)) / width), F.lit(BINS - 1)).cast("int").alias("bucket") if width > 0 else F.when(v == low, 0).otherwise(1).alias("bucket")
        found = some.where(v.between(low, high)).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        found.sort(key=lambda r: r["low"])
        at = 0
        while below + found[at]["n"] <= k:
            below += found[at]["n"]
            at += 1
        if at + 1 < len(found):
            above = found[at + 1]["low"]
        low, high, count = found[at]["low"], found[at]["high"], found[at]["n"]
    after = low if k + 1 < below + count or p == k else above
    return low, after, p


def quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row, quantile: exact, between the two values around it; null without values."""
    found = order_statistics(df, value, lambda n: (n - 1) * share)
    exact = None if found is None else float(found[0]) + (float(found[1]) - float(found[0])) * (found[2] - found[2] // 1)
    return df.sparkSession.range(1).select(F.lit(exact).cast("double").alias("quantile"))


def recommended_size(distances: DataFrame, capacity: int) -> DataFrame:
    """p80 of the reuse distances, and whether the cache should grow (p80 above 1.5 times it), shrink (below 0.7) or stay."""
    p = F.col("quantile")
    advice = F.when(p > 1.5 * capacity, "grow").when(p < 0.7 * capacity, "shrink").otherwise("keep")
    return quantile(distances, "distance", 0.8).select(p.alias("p80"), F.lit(capacity).cast("long").alias("capacity"), advice.alias("advice"))


def working_set(log: DataFrame, capacity: int) -> DataFrame:
    """n_tiles, ratio to the capacity and what that means."""
    ratio = F.col("n_tiles") / capacity
    kind = F.when(ratio > 4, "far larger").when(ratio > 1.5, "larger").otherwise("fits")
    return log.agg(F.count_distinct("tile").alias("n_tiles")).select("n_tiles", ratio.alias("ratio"), kind.alias("verdict"))


def advice(log: DataFrame, capacity: int) -> DataFrame:
    """One row: rates over the full log and the rules that they meet."""
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    rates = log.agg(share("HIT").alias("hit_rate"), share("EVICT").alias("evict_rate"), (F.count_distinct("tile") / capacity).alias("working_set"))
    rules = [(F.col("hit_rate") < 0.6, "low hit rate"), (F.col("evict_rate") > 0.15, "many evictions"), (F.col("evict_rate") < 0.01, "cache never fills"), (F.col("working_set") > 3, "working set too large")]
    return rates.withColumn("advice", F.coalesce(F.nullif(F.concat_ws("; ", *(F.when(test, text) for test, text in rules)), F.lit("")), F.lit("none")))


def profile_summary(entries: DataFrame) -> DataFrame:
    """name, n, total, mean, least, most of entries(name, duration)."""
    d = F.col("duration")
    return entries.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))
