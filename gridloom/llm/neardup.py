"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. A scan turns each text into its set of word shingles (64-bit hashes), a digest of the set and the band keys
   of its SuperMinHash signature. Documents with equal sets collapse to one representative first, so thousands
   of copies cost one row from there on.
2. Representatives that share a band key become candidates as a star around the bucket's smallest one: as many
   pairs as bucket members, whatever a bucket's size. Each pair is verified on both full sets.
3. Verified links are grouped: a union-find inside each partition, then rounds of contraction between them.
4. What a star cannot tell, blocks do: where members of one bucket still lie in different groups, the buckets
   are gathered into clusters, and members outside a cluster's main group are compared with all its members,
   block against block inside a task. Only verified links come out. So no link of a shared bucket is lost, and
   no pairs of a group are ever written out.

A pair of similarity 0.8 shares no bucket with a probability of (1 - 0.8**ROWS)**BANDS, 5 in a million here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_words, materialise, semi_join

ROWS = 6  # signature components in a band
BANDS = 40
SIGNATURE = ROWS * BANDS
CELL_BYTES = 32 << 20  # bytes of sets on either side of a cell of the second comparison, about
CELL_SETS = 64  # sets on a side of such a cell below which a cluster is not cut further
AT_ONCE = 40_000  # shingles whose signatures are made together: bounds a task's memory
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; fewer words are one shingle, no words none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash of non-empty sets: (sets, m) uint64, component i being the least of rank + fraction over the elements.

    Every element draws a permutation of the components, one rank after the other; its value for the component
    that it draws at rank j lies in [j, j + 1). A set is done, and stops drawing, at the first rank after which
    all its components have values: no later rank could lower one.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    swaps = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(element), m))
    for j in range(m):
        draw = _mixed(element + np.uint64((j + 1) * int(_MIX[0]) % 2**64))
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            component = pick
        else:
            if j == 1:
                swaps = swaps.copy()
                swaps[np.arange(len(element)), last] = 0
            line = np.arange(len(element))
            component = swaps[line, pick].astype(np.int64)
            swaps[line, pick] = swaps[:, j]
        np.minimum.at(best, owner * m + component, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_set = (best.reshape(-1, m) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_set.any():
            break
        keep = open_set[owner]
        owner, element, last = owner[keep], element[keep], pick[keep]
        swaps = swaps[keep] if j else swaps[: len(element)]
    return best.reshape(-1, m)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) int64: a hash of each band's number and components."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)).copy()
    for r in range(rows):
        key = _mixed(key * _MIX[0] + parts[:, :, r])
    return key.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo = 0
        texts = batch.column(1).to_pylist()
        while lo < batch.num_rows:
            sets, size = [], 0
            while lo + len(sets) < batch.num_rows and (not sets or size < AT_ONCE):
                sets.append(shingle_hashes(texts[lo + len(sets)], k))
                size += len(sets[-1])
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)).tolist()) if full else iter(())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "digest", "keys"])
            lo += len(sets)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            members = [shingle_hashes(t, k).tobytes() for t in batch.column(0).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(m) for m in members], pa.binary()), pa.array(members, pa.binary())], ["digest", "members"])


def jaccard_reached(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, members_a, members_b) -> the (a, b) that are similar enough."""
    for batch in batches:
        left, right = (batch.column(i).to_pylist() for i in (2, 3))
        keep = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(a) + len(b) - len(np.union1d(a, b)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
            keep.append(jaccard_reached(shared, len(a), len(b), percent))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _between(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """(rep, part, members) of both sides of a cell: links that join its different parts, fewer than it has parts.

    A left set is compared only with sets whose parts no link of this cell has joined to its own, so links span what
    similar sets connect and no group is written out in pairs.
    """
    links = []
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("members")]
    reps, parts = right.column("rep").to_numpy(), right.column("part").to_numpy()
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, reps = [sets[i] for i in order], reps[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    # The part of each set, renamed as parts are joined; left sets come after the right ones.
    part = np.concatenate([parts[order], left.column("part").to_numpy()])
    for at_left, (rep, members) in enumerate(zip(left.column("rep").to_pylist(), left.column("members")), len(sets)):
        own = np.frombuffer(members.as_buffer(), np.uint64)
        # Only sets of a fitting size can be similar enough: a range, since they are sorted by size.
        lo, hi = np.searchsorted(100 * sizes, percent * len(own)), np.searchsorted(percent * sizes, 100 * len(own), "right")
        while lo < hi:
            some = np.arange(lo, min(lo + 256, hi))
            lo += 256
            some = some[part[some] != part[at_left]]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            ends = np.cumsum(sizes[some])
            shared = np.diff(np.concatenate([[0], np.cumsum(own[at] == flat)[ends - 1]]))
            for i in some[100 * shared >= percent * (sizes[some] + len(own) - shared)]:
                if part[i] != part[at_left]:
                    links.append((rep, int(reps[i])))
                    part[part == part[i]] = part[at_left]
    return pa.table({c: pa.array([p[i] for p in links], pa.int64()) for i, c in enumerate("ab")})


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each of its nodes with the smallest node that it is joined to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for lo in range(0, len(nodes), 65_536):
        some = nodes[lo : lo + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b); a node without links does not appear.

    Each round runs a union-find inside every partition, hooks every node to its smallest neighbour, and goes on
    with the links between what is left; path lengths halve at least.
    """
    found = None
    links = links.select("a", "b").where("a <> b")
    while True:
        star = materialise(links.mapInArrow(_forest, "a long, b long"), "forest")
        if star.isEmpty():
            break
        both = star.union(star.select("b", "a"))
        hooks = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "hooks")
        if found is None:
            found = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            fresh = hooks.join(found.select("node"), "node", "left_anti")
            found = materialise(moved.union(fresh), "roots")
        left, right = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        links = star.join(left, "a").join(right, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
    if found is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return found.withColumnRenamed("root", "component")


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: row (its number here), doc_id, n_shingles, component_id, kept, first (one row of each group).

    Link: 100 * |intersection| >= percent * |union| of the shingle sets. component_id is the smallest doc_id that
    links reach. Texts without words, and nulls, are linked with nothing. Repeated rows are rows of one group; a
    null doc_id never is a component_id unless a whole group has none, and is not kept; of each group exactly one
    row is first (smallest doc_id, nulls last). An empty table gives none. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = materialise(docs.mapInArrow(lambda b: _features(b, shingle), "doc_id long, n_shingles long, digest binary, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "features")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    reps = materialise(features.where("digest is not null").groupBy("digest").agg(F.min(rank).alias("rank"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min("row").alias("rep")), "reps")

    members = reps.select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(members.join(buckets, "key").select("key", "low", "size", "rep"), "shared")
    pairs = materialise(shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")

    # The full sets of all candidates, from a second scan.
    wanted = reps.select("rep", F.col("rank.doc_id").alias("doc_id"), "digest").join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = _full_sets(docs, materialise(wanted, "wanted"), shingle)
    links = _verify(pairs, sets, percent)
    found = components(links)

    # Buckets whose members still are in different groups.
    part = shared.where("size > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    part = materialise(part, "parts")
    unsettled = part.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    loose = part.join(unsettled, "key").select("low", "rep", "part")
    clusters = components(loose.select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    more = _second_look(clusters, found, sets, percent)
    if not more.isEmpty():
        found = components(links.union(more))

    label = reps.select("digest", "rank", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    label = materialise(label.select("digest", "rank", "component"), "labels")
    best = materialise(label.groupBy("component").agg(F.min("rank").alias("best")), "best")  # as a table: then Spark can split a large component in the join
    by_set = materialise(label.join(best, "component").select("digest", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first_row")), "by_set")
    rows = features.drop("keys")
    grouped = rows.where("digest is not null").join(by_set, "digest").select("row", "doc_id", "n_shingles", "component_id", F.expr("row = first_row").alias("first"))
    alone = rows.where("digest is null").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return grouped.union(alone).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(False)))


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """rep, members: the shingle hashes of the wanted representatives (rep, doc_id, digest), from the whole texts. Texts are found by doc_id, and told apart by their set's digest where a doc_id is repeated or null."""
    nameless = not wanted.where("doc_id is null").isEmpty()
    texts = semi_join(docs, wanted.select("doc_id").where("doc_id is not null").distinct(), "doc_id")
    texts = texts.union(docs.where("doc_id is null")) if nameless else texts
    sets = texts.select("text").mapInArrow(lambda b: _sets(b, shingle), "digest binary, members binary").dropDuplicates(["digest"])
    return materialise(wanted.select("rep", "digest").join(sets, "digest").select("rep", "members"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A bucket's smallest member stands in many pairs: its set is dealt to as many salts as they need."""
    per_salt = 64
    need = materialise(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_salt).alias("salts")), "salts")
    salted = pairs.join(need, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts")).drop("salts")
    left = sets.withColumnsRenamed({"rep": "a", "members": "members_a"}).join(need, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    both = salted.join(left, ["a", "salt"]).join(sets.withColumnsRenamed({"rep": "b", "members": "members_b"}), "b").select("a", "b", "members_a", "members_b")
    return materialise(both.mapInArrow(lambda x: _verified(x, percent), "a long, b long"), "links")


def _second_look(clusters: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one cluster that are in different groups: members outside the cluster's largest group against all members. A cell hands on the links that span its groups.

    A cluster is a grid of g x g cells, each of which meets in one task: a g-th of the left members and a g-th of all. A
    set is shuffled g times, where g is what the tasks' number asks for, and more only where a cell would hold too many bytes.
    """
    inside = clusters.withColumnsRenamed({"node": "rep", "component": "cluster"}).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).select("cluster", "rep", "part")
    inside = materialise(inside.join(sets, "rep"), "clusters")
    sizes = inside.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("members")).alias("bytes"))
    tasks = sets.sparkSession.sparkContext.defaultParallelism
    spread = F.least(F.ceil(F.sum("n") / CELL_SETS), F.lit(math.isqrt(8 * tasks) + 1))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("top"), F.greatest(spread, F.ceil(F.sum("bytes") / CELL_BYTES)).alias("g")).select("cluster", F.col("top.part").alias("main"), "g")
    named = inside.join(materialise(main, "grids"), "cluster")
    own, every = F.pmod(F.xxhash64("rep"), F.col("g")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    left = named.where("part <> main").select("cluster", own.alias("down"), every.alias("across"), "rep", "part", "members")
    right = named.select("cluster", every.alias("down"), own.alias("across"), "rep", "part", "members")
    cell = ["cluster", "down", "across"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda k, x, y: _between(k, x, y, percent), "a long, b long")
    return materialise(found.distinct(), "more")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first document of each group of near-duplicates; columns as they were.

    docs is read twice and must give the same rows in the same order each time, as a scan of files does.
    """
    columns = docs.columns
    numbered = docs.withColumn("gridloom_row", F.monotonically_increasing_id())
    first = groups(docs, shingle, percent).where("first").select(F.col("row").alias("gridloom_row"))
    return numbered.join(first, "gridloom_row", "left_semi").select(*columns)
