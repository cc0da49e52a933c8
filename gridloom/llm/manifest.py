"""A Merkle manifest of a dataset: one tree a language, one tree over the languages' roots.

A tree is stored in blocks: aligned subtrees of HEIGHT levels of edges, one row each, built by one task from its
leaves. The blocks' roots are the leaves of the next level of blocks, and so on until every tree has one block. Inside
a block the nodes lie in the van Emde Boas order: the upper half of the levels first, then each lower subtree, each of
them ordered in the same way; places are computed, not stored. Going down again, a block's siblings on the way to
the root are joined to it once, and its leaves take theirs from the block.

Texts never move: leaves are digests, and rows of equal digest and id travel as one row with a count. Places in a tree
come from range partitions with the counts of the partitions before, so no task holds a language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import crc_remainder, materialise

HEIGHT = 12  # of a full block: 4,096 leaves
TAMPERED = 7
DIGEST, STEP = 32, 33  # bytes of a node, and of a step: 0 none, 1 right or 2 left, and the sibling
BLOCKS = "tree string, block long, n int, height int, nodes binary, lone array<int>, ids array<long>, others array<binary>"
PATHS = "tree string, block long, path binary, subroot binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# ---- One block


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes number `index` at `depth` (the root's is 0) of a complete tree of so many levels, in the van Emde Boas order."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels, depth = levels - upper, depth - upper
        at += (1 << upper) - 1 + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return at


@cache
def places(levels: int) -> list[list[int]]:
    """address() of every node, by its height above the leaves."""
    return [address(levels, depth, np.arange(1 << depth)).tolist() for depth in range(levels - 1, -1, -1)]


def joined(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def build(leaves: list[bytes]) -> tuple[int, bytes]:
    """Height and nodes of the smallest tree over the leaves. Places without a node are zero."""
    height = (len(leaves) - 1).bit_length()
    at, out, row = places(height + 1), bytearray(DIGEST * ((2 << height) - 1)), leaves
    for h in range(height + 1):
        if h:
            row = [joined(*row[k : k + 2]) for k in range(0, len(row), 2)]
        for p, node in zip(at[h], row):
            out[DIGEST * p : DIGEST * (p + 1)] = node
    return height, bytes(out)


def steps(nodes: bytes, n: int, height: int, leaf: int) -> bytes:
    """From a leaf to the block's root: the sibling of each step, retrieved by its address."""
    at, out = places(height + 1), []
    for h in range(height):
        k, sibling = leaf >> h, (leaf >> h) ^ 1
        if sibling < -(-n // (1 << h)):
            p = at[h][sibling]
            out.append((b"\2" if k & 1 else b"\1") + nodes[DIGEST * p : DIGEST * (p + 1)])
        else:
            out.append(bytes(STEP))
    return b"".join(out)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and the siblings on its way."""
    for k in range(0, len(path), STEP):
        side, sibling = path[k], path[k + 1 : k + STEP]
        node = joined(node) if not side else joined(sibling, node) if side == 2 else joined(node, sibling)
    return node


def proof(path: bytes) -> str:
    return hashlib.sha256(b"".join(path[k + 1 : k + STEP].hex().encode() for k in range(0, len(path), STEP) if path[k])).hexdigest()


# ---- Construction


def _block(key: tuple[pa.Scalar, ...], table: pa.Table, height: int) -> pa.Table:
    """(tree, block; at, n, digest, height, id, other) -> one block. Leaves that are roots of blocks below are hashed up to those blocks' full height, unless the tree ends with it."""
    tree, block = (k.as_py() for k in key)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "n", "digest", "height", "id", "other"))), key=lambda r: r[0])
    leaves, lone, ids, others = [], [], [], []
    alone = block == 0 and len(rows) == 1
    for _, n, digest, h, i, other in rows:
        up = 0 if h is None or alone else height - h
        for _ in range(up):
            digest = joined(digest)
        leaves += [digest] * n
        lone += [up] * n
        ids += [i] * n
        others += [other] * n
    h, nodes = build(leaves)
    columns = [[tree], [block], [len(leaves)], [h], [nodes], [lone], [ids], [others]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(BLOCKS.split(", "), columns, kinds)})


def levels_of(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The levels of blocks, each written once, over runs of equal leaves (tree, start, n, digest, id, other): places from 0 in each tree."""
    width = 1 << height
    run = leaves.withColumn("block", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + n - 1) div {width}"))))
    first, end = F.greatest("start", F.col("block") * width), F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * width)
    members = run.select("tree", "block", first.alias("at"), (end - first).cast("int").alias("n"), "digest", F.lit(None).cast("int").alias("height"), "id", "other")
    out = []
    while True:
        out.append(materialise(members.groupBy("tree", "block").applyInArrow(lambda k, t: _block(k, t, height), BLOCKS), "blocks"))
        if out[-1].where("block > 0").isEmpty():
            return out
        below = out[-1].select("tree", F.expr(f"block div {width}").alias("above"), F.col("block").alias("at"), F.substring("nodes", 1, DIGEST).alias("digest"), "height")
        members = below.select("tree", F.col("above").alias("block"), "at", F.lit(1).alias("n"), "digest", "height", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their ways to the root -> the ways of their leaves, which are blocks of the level below."""
    for batch in batches:
        for r in batch.to_pylist():
            start, n = r["block"] * r["width"], r["n"]
            ways = [bytes(STEP * up) + steps(r["nodes"], n, r["height"], k) + r["path"] for k, up in enumerate(r["lone"])]
            yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.string()), pa.array(range(start, start + n), pa.int64()), pa.array(ways, pa.binary()), pa.array([r["subroot"]] * n, pa.binary())], [f.split()[0] for f in PATHS.split(", ")])


def down(levels: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """PATHS of the blocks of the lowest level, from those of the highest, where each tree has its block 0."""
    paths = top
    for level in reversed(levels[1:]):
        paths = level.join(paths, ["tree", "block"]).withColumn("width", F.lit(1 << height)).mapInArrow(_ways, PATHS)
    return paths


def _proofs(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PROOFS.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            at, rows = places(r["height"] + 1)[0], []
            for k, (i, other) in enumerate(zip(r["ids"], r["others"])):
                leaf = r["nodes"][DIGEST * at[k] : DIGEST * (at[k] + 1)]
                path = steps(r["nodes"], r["n"], r["height"], k) + r["path"]
                folded = fold(other or leaf, path)
                rows.append((i, leaf.hex(), r["subroot"].hex(), root.hex(), proof(path), folded.hex(), folded == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


# ---- Leaves and their places


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: each value with its length in front, or "-"."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def placed(runs: DataFrame, order: list[str]) -> DataFrame:
    """runs with start: how many rows of the same tree come before, in the given order, which tells the runs of a tree apart. n: rows of a run."""
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(runs.repartitionByRange(partitions, "tree", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("tree", "_range").agg(F.sum("n").alias("n")).withColumn("_before", before(Window.partitionBy("tree").orderBy("_range"))).drop("n")
    inside = dealt.withColumn("_inside", before(Window.partitionBy("tree", "_range").orderBy(*order)))
    return inside.join(ranges, ["tree", "_range"]).withColumn("start", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of blocks of the languages' trees and of the tree over them."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    more = F.when((crc_remainder(c["doc_id"], TAMPERED) == 0) & c["n_chars"].isNotNull(), leaf(c["doc_id"], c["source"], c["lang"], c["n_chars"].cast("decimal(20,0)") + 1, c["text"]))
    tree = F.coalesce(F.concat(F.lit("="), c["lang"]), F.lit("-"))  # null goes first
    rows = docs.select(tree.alias("tree"), c["doc_id"].cast("long").alias("id"), leaf(*c.values()).alias("digest"), more.alias("other"))
    runs = rows.groupBy("tree", "id", "digest", "other").agg(F.count(F.lit(1)).alias("n"))
    trees = levels_of(placed(runs, ["id", "digest"]), height)
    tops = trees[-1].select(F.lit("").alias("tree"), F.lit(1).cast("long").alias("n"), F.substring("nodes", 1, DIGEST).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"), F.col("tree").alias("name"))
    return trees, levels_of(placed(tops, ["name"]), height)


def proved(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Rows without a language make a tree of their own, rows without an id come first in theirs and are never tampered with.
    Rows of one id go by their digest; equal rows are leaves of their own. An empty table gives no rows. Columns beside
    doc_id, source, lang, n_chars and text are not read.
    """
    trees, over = manifest(docs, height)
    whole = over[-1].select("nodes").first()
    root = bytes(whole[0][:DIGEST]) if whole else b""
    top = over[-1].select("tree", "block", F.lit(b"").cast("binary").alias("path"), F.lit(b"").cast("binary").alias("subroot"))
    lowest = down(over, top, height)
    ways = over[0].join(lowest, ["tree", "block"]).withColumn("width", F.lit(1 << height)).mapInArrow(_ways, PATHS).select(F.col("block").alias("start"), "path")
    named = placed(trees[-1].select(F.lit("").alias("tree"), F.lit(1).cast("long").alias("n"), F.col("tree").alias("name"), F.substring("nodes", 1, DIGEST).alias("subroot")), ["name"])
    tops = named.join(ways, "start").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "subroot")
    return trees[0].join(down(trees, tops, height), ["tree", "block"]).mapInArrow(lambda b: _proofs(b, root), PROOFS)


def oracle() -> str:
    field = lambda c: f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda n: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n, 'text')))})"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: {byte}), 4294967295)"
    above = "sha256(string_agg(h, '' ORDER BY pos))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {digest('n_chars')} AS leaf, CASE WHEN {crc} % {TAMPERED} = 0 THEN {digest('n_chars + 1')} END AS other FROM documents),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, ROW_NUMBER() OVER () AS rid FROM d),
    t(tree, level, pos, h) AS (SELECT tree, 0, pos, leaf FROM p UNION ALL SELECT tree, level + 1, pos // 2, {above} FROM (SELECT *, COUNT(*) OVER (PARTITION BY tree) AS c FROM t) x WHERE c > 1 GROUP BY tree, level + 1, pos // 2),
    s AS (SELECT tree, h AS subroot, ROW_NUMBER() OVER (ORDER BY tree) - 1 AS pos FROM (SELECT *, MAX(level) OVER (PARTITION BY tree) AS top FROM t) x WHERE level = top),
    u(level, pos, h) AS (SELECT 0, pos, subroot FROM s UNION ALL SELECT level + 1, pos // 2, {above} FROM (SELECT *, COUNT(*) OVER () AS c FROM u) x WHERE c > 1 GROUP BY level + 1, pos // 2),
    r AS (SELECT h AS root FROM u WHERE level = (SELECT MAX(level) FROM u)),
    g AS (SELECT p.rid, l.level AS k, p.pos >> l.level AS place, t.h FROM p JOIN (SELECT DISTINCT tree, level FROM t) l ON p.tree = l.tree LEFT JOIN t ON t.tree = p.tree AND t.level = l.level AND t.pos = xor(p.pos >> l.level, 1) WHERE l.level < (SELECT MAX(level) FROM t y WHERE y.tree = p.tree)
        UNION ALL SELECT p.rid, 1000 + l.level, s.pos >> l.level, u.h FROM p JOIN s ON p.tree = s.tree CROSS JOIN (SELECT DISTINCT level FROM u WHERE level < (SELECT MAX(level) FROM u)) l LEFT JOIN u ON u.level = l.level AND u.pos = xor(s.pos >> l.level, 1)),
    w AS (SELECT rid, list(CASE WHEN h IS NULL THEN 'N' WHEN place & 1 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY k) AS way, string_agg(h, '' ORDER BY k) AS siblings FROM g GROUP BY rid),
    f AS (SELECT p.*, COALESCE(w.siblings, '') AS siblings, list_reduce([COALESCE(other, leaf)] || COALESCE(w.way, []), lambda a, x: CASE x[1:1] WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM p LEFT JOIN w ON p.rid = w.rid)
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM f JOIN s ON f.tree = s.tree CROSS JOIN r"""
