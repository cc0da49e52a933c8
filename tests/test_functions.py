"""Cache analytics against plain Python, access orders, observability, the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import cache_stats as stats
from gridloom.functions import working_set
from gridloom.functions.observability import Profiler, ResourceMonitor, Tracer, profiler, setup_logging
from gridloom.plans import cost
from gridloom.streaming.rates import streaming_rates

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, ["HIT", "HIT", "MISS", "EVICT"][RNG.integers(4)], "AB"[RNG.integers(2)], int(RNG.integers(4)), int(RNG.integers(4)), int(RNG.integers(3) if i % 3 else 0), int(RNG.integers(64))) for i in range(700)]
    return rows, spark.createDataFrame(rows, "seq long, event_type string, matrix string, r long, c long, tile long, cache_len long").cache()


def test_previous_over_chunks(log, monkeypatch):
    rows, df = log
    monkeypatch.setattr(stats, "CHUNK", 16)
    last, want = {}, {}
    for seq, kind, *_, tile, _ in rows:
        if kind != "EVICT":
            if tile in last:
                want[seq] = seq - last[tile]
            last[tile] = seq
    assert {r.seq: r.distance for r in stats.reuse_distances(df).collect()} == want
    at = [r[0] for r in rows if r[1] == "EVICT"]
    assert {r.seq: r.gap for r in stats.eviction_gaps(df).collect()} == {b: b - a for a, b in zip(at, at[1:])}
    d = np.array(list(want.values()))
    curve = {r.cache_size: r.miss_rate for r in stats.miss_curve(stats.reuse_distances(df)).collect()}
    assert all(abs(curve[s] - (d > s).mean()) < 1e-12 for s in range(16, 513, 16))
    assert abs(stats.recommended_size(stats.reuse_distances(df), 64).first().p80 - np.percentile(d, 80)) < 1e-9
    assert sum(r.n for r in stats.distance_histogram(stats.reuse_distances(df)).collect()) == len(d)


def test_rates(log):
    rows, df = log
    assert {r.event_type: r.n for r in stats.event_counts(df).collect()} == {k: sum(x[1] == k for x in rows) for k in ("HIT", "MISS", "EVICT")}
    got = {r.window: r for r in stats.windowed_rates(df, 64).collect()}
    assert set(got) == set(range(7)) and abs(got[3].hit_rate - np.mean([x[1] == "HIT" for x in rows[300:400]])) < 1e-12
    assert stats.sampled(df, 100).count() == 100 and stats.working_set(df, 2).first().verdict == "fits" and stats.working_set(df, 1).first().verdict == "larger"
    assert stats.advice(df, 64).first().advice == "low hit rate; many evictions"
    assert stats.timeline(df).agg(F.max("tile_rank")).first()[0] == 3
    heat = {(r.r, r.c): r.difference for r in stats.heat_map(df).collect()}
    assert heat[0, 0] == sum((1 if x[2] == "A" else -1) for x in rows if x[1] != "EVICT" and x[3] == x[4] == 0)


def test_empty_log(log):
    none = log[1].limit(0)
    assert stats.event_counts(none).count() == 0 and stats.reuse_distances(none).count() == 0 and stats.windowed_rates(none, 64).count() == 0
    assert stats.miss_curve(stats.reuse_distances(none)).where("miss_rate is not null").count() == 0


def test_accesses(spark):
    got = [tuple(r) for r in cost.product_accesses(spark, 4, 4, 4, tile=2).orderBy("pos").collect()]
    want = [x for r in (0, 2) for c in (0, 2) for k in (0, 2) for x in (("A", r, k), ("B", k, c))]
    assert got == [(n, *x) for n, x in enumerate(want)]
    assert cost.elementwise_accesses(spark, 3, 5, ["A", "B"], 2).count() == 12 and cost.tile_grid(spark, 3, 5, 2).count() == 6
    assert cost.product_accesses(spark, 8192, 8192, 8192).count() == 1024


def test_profiler_and_tracer(spark, folder):
    p = Profiler(spark)
    with pytest.raises(ZeroDivisionError), p.span("bad"):
        1 / 0
    with p.span("outer", k=1), p.span("inner"):
        pass
    assert p.timed("f")(lambda x: x + 1)(1) == 2
    names = {r.name: r.n for r in p.summary(spark).collect()}
    assert names == {"bad": 1, "outer": 1, "inner": 1, "f": 1}
    p.export(f"{folder}/p.json")
    assert len(json.load(open(f"{folder}/p.json"))["spans"]) == 4
    p.reset()
    p.enabled = False
    with p.span("off"):
        pass
    assert not p.entries and profiler() is profiler()
    t = Tracer()
    t.begin("a")
    t.log("x", k=2)
    t.end("a")
    assert [(e.type, e.depth) for e in t.events] == [("begin", 0), ("log", 1), ("end", 0)] and t.lines()[1] == "  log x"
    t.save(f"{folder}/t.json")
    assert len(json.load(open(f"{folder}/t.json"))) == 3
    log = setup_logging(file=f"{folder}/l.log")
    n = len(log.handlers)
    setup_logging(file=f"{folder}/l.log").debug("hello")
    assert len(log.handlers) == n and "hello" in open(f"{folder}/l.log").read()
    with ResourceMonitor(0.02) as m:
        sum(range(3_000_000))
    assert m.seconds > 0 and m.peak_mb >= 0


def test_stream(spark, folder):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", k) for h in range(4) for k in ("HIT", "HIT", "MISS", "EVICT")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    rows.write.parquet(f"{folder}/in")
    q = streaming_rates(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rates").collect()
    assert len(got) == 4 and all(r.n == 4 and r.hit_rate == 0.5 and r.evict_rate == 0.25 for r in got)


def test_selection(spark, monkeypatch):
    """Exact like a sort: ties, negative, huge, equal, few and no values; a bounded number of rows a round."""
    import random

    import numpy as np

    rng = random.Random(4)
    cases = [[5], [1, 1, 1, 1], [3, 1, 2], [rng.randint(-1000, 1000) for _ in range(500)], [7] * 300 + [rng.randint(0, 9) for _ in range(200)], [-(2**62), 0, 2**62]]
    floats = [[0.5, float("nan"), 1.5, None, 2.5], [1e-300, 1e300, 1.0, -1e300, 5e-324, 0.0], [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(400)]]
    for bins in (2048, 3):
        monkeypatch.setattr(stats, "BINS", bins)
        for values, kind in [*((c, "long") for c in cases), *((c, "double") for c in floats)]:
            if bins == 3 and len(values) > 5:
                continue
            df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
            real = [v for v in values if v is not None and v == v]
            for share in (0.0, 0.37, 1.0):
                got = stats.quantile(df, "x", share).first()[0]
                low, high, p = stats.order_statistics(df, "x", lambda n, share=share: (n - 1) * share)
                assert low == sorted(real)[int(p)] and high == sorted(real)[-int(-p // 1)]
                np.testing.assert_allclose(got, low + (high - low) * (p % 1))
    assert stats.quantile(spark.createDataFrame([], "x double"), "x", 0.5).first()[0] is None


def test_heat_pyramid_has_one_exchange(spark):
    log = spark.createDataFrame([(k, "HIT" if k % 5 else "EVICT", "AB"[k % 2], k % 8, k * 3 % 8) for k in range(400)], "seq long, event_type string, matrix string, r long, c long")
    got = stats.heat_pyramid(log)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for k in range(400):
        for level in range(4):
            if k % 5:
                key = level, k % 8 >> level, k * 3 % 8 >> level
                want[key] = want.get(key, (0, 0))[0] + (k % 2 == 0), want.get(key, (0, 0))[1] + k % 2
    assert {(r.level, r.r, r.c): (r.a_count, r.b_count) for r in got.collect()} == want


@pytest.mark.parametrize("block,fan", [(2048, 64), (8, 4)])
def test_stack_distances(spark, monkeypatch, block, fan):
    """Against counting by hand, over several levels of blocks, with a tile that has a third of the accesses; and the curve against a cache that drops the least recently used."""
    import random

    from gridloom.functions import stack_distance

    monkeypatch.setattr(stack_distance, "BLOCK", block)
    monkeypatch.setattr(stack_distance, "FAN", fan)
    monkeypatch.setattr(stack_distance, "AT_ONCE", 50)
    rng = random.Random(9)
    tiles = [7 if rng.random() < 0.34 else rng.randint(0, 60) for _ in range(900)]
    kinds = [rng.choice(["HIT", "MISS", "EVICT"]) for _ in tiles]
    log = spark.createDataFrame([(3 * k, e, t) for k, (e, t) in enumerate(zip(kinds, tiles))], "seq long, event_type string, tile long")
    want, last, order = {}, {}, [(3 * k, t) for k, (e, t) in enumerate(zip(kinds, tiles)) if e != "EVICT"]
    for n, (seq, tile) in enumerate(order):
        if tile in last:
            want[seq] = len({t for _, t in order[last[tile] + 1 : n]})
        last[tile] = n
    got = stack_distance.stack_distances(log)
    assert {r.seq: r.depth for r in got.collect()} == want
    curve = {r.cache_size: r.miss_rate for r in stack_distance.exact_miss_curve(got, 8, 4).collect()}
    for size in (8, 16, 24, 32):
        cache, missed = [], 0
        for seq, tile in order:
            missed += seq in want and tile not in cache
            cache = [tile, *(t for t in cache if t != tile)][:size]
        assert abs(curve[size] - missed / len(want)) < 1e-12
    assert stack_distance.stack_distances(log.limit(0)).count() == 0


def test_mean_tiles_of_windows(log, spark, monkeypatch):
    rows, df = log
    monkeypatch.setattr(stats, "CHUNK", 16)
    seen = [r[5] if r[1] != "EVICT" else None for r in rows]
    lengths = [1, 2, 3, 7, 64, 500, 699, 700, 701, 5000]
    got = {r.length: (r.windows, r.mean_tiles) for r in working_set.mean_tiles(df, lengths).collect()}
    assert sorted(got) == [x for x in lengths if x <= 700]
    for w, (windows, mean) in got.items():
        want = [len({t for t in seen[s : s + w] if t is not None}) for s in range(700 - w + 1)]
        assert windows == len(want) and abs(mean - np.mean(want)) < 1e-9
    assert working_set.mean_tiles(df.limit(0), lengths).isEmpty()
    with pytest.raises(ValueError):
        working_set.mean_tiles(df, [0, 3])


def test_sketches_of_intervals_unite(spark):
    rng = np.random.default_rng(2)
    tiles = (rng.integers(0, 4000, 40_000) + np.arange(40_000) // 10).tolist()
    df = spark.createDataFrame([(i, "HIT" if i % 3 else "EVICT", t) for i, t in enumerate(tiles)], "seq long, event_type string, tile long")
    sketches = working_set.interval_sketches(df, 2_000).cache()
    for together in (1, 4, 20):
        want = {k: len({tiles[i] for i in range(k * 2_000 * together, min((k + 1) * 2_000 * together, 40_000)) if i % 3}) for k in range(20 // together)}
        got = {r.interval: r.n_tiles for r in working_set.sketched_tiles(sketches, together).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.08 * want[k] for k in want)
