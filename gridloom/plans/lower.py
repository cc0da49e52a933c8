"""From the lazy tree to one DataFrame of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import blocks, cells, vectors
from gridloom.plans import dtypes
from gridloom.plans.logical import Add, Leaf, MatMul, Node, Scale, Transpose
from gridloom.plans.rules import rewrite
from gridloom.sources.shared import materialise

#: Products of cells (rows x inner x columns) beyond which whole blocks are multiplied instead.
CELL_PRODUCTS = 200_000_000


def lower(node: Node) -> DataFrame:
    """The tree's cells (i, j, v), after the rewrites. Equal subtrees are lowered once. A product that several nodes use is computed and written once; the small side of a tall product is computed too, and sent with the tasks."""
    root = rewrite(node)
    used = parents(root)
    done: dict[int, tuple[Node, DataFrame]] = {}

    def visit(n: Node) -> DataFrame:
        if id(n) not in done:
            df = _lowered(n, visit)
            done[id(n)] = n, materialise(df, "shared-product") if isinstance(n, MatMul) and used.get(id(n), 0) > 1 else df
        return done[id(n)][1]

    return visit(root)


def parents(root: Node) -> dict[int, int]:
    """How often the plan of the tree reads each node: a sum of a matrix with itself reads it once."""
    found: dict[int, int] = {}
    seen, stack = {id(root)}, [root]
    while stack:
        n = stack.pop()
        once = isinstance(n, Add) and n.left is n.right and n.sign == 1
        for x in n.inputs[:1] if once else n.inputs:
            found[id(x)] = found.get(id(x), 0) + 1
            if id(x) not in seen:
                seen.add(id(x))
                stack.append(x)
    return found


def _lowered(n: Node, visit) -> DataFrame:
    kind = dtypes.spark_type(n.dtype)
    if isinstance(n, Leaf):
        return n.cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast(kind).alias("v"))
    if isinstance(n, Scale):
        return cells.scale(visit(n.child), n.scalar, kind)
    if isinstance(n, Transpose):
        return cells.transpose(visit(n.child))
    if isinstance(n, Add):
        if n.left is n.right and n.sign == 1:
            return cells.doubled(visit(n.left), kind)
        return cells.add(visit(n.left), visit(n.right), kind, n.sign)
    assert isinstance(n, MatMul)
    how = method(n)
    if how == "blocks":
        size = blocks.BLOCK
        counts = [-(-x // size) for x in (n.rows, n.cols, n.left.cols)]
        product = blocks.matmul(blocks.to_blocks(visit(n.left), *n.left.shape, kind=kind), blocks.to_blocks(visit(n.right), *n.right.shape, kind=kind), *counts)
        return blocks.to_cells(product, kind)
    if how == "cells":
        return cells.matmul(visit(n.left), visit(n.right), kind, n.left.rows * n.left.cols, n.right.rows * n.right.cols)
    wide = "bigint" if kind == "bigint" else "double"
    numpy = "int64" if kind == "bigint" else "float64"
    if how == "inner":
        turned = _transposed(n.left)
        found = vectors.inner(rows_of(turned, visit, wide), None if turned is n.right else rows_of(n.right, visit, wide), n.rows, n.cols, wide)
    elif how == "tall":
        found = vectors.times(rows_of(n.left, visit, wide), vectors.collected(visit(n.right), *n.right.shape, numpy))
    else:
        found = cells.transpose(vectors.times(rows_of(_transposed(n.right), visit, wide), vectors.collected(visit(n.left), *n.left.shape, numpy).T.copy()))
    return found.select("i", "j", F.col("v").cast(kind).alias("v"))


def _transposed(n: Node) -> Node:
    return n.child if isinstance(n, Transpose) else Transpose(n)


def natural(n: Node) -> DataFrame | None:
    """A node's rows as vectors, where its leaf has them and nothing but scaling stands between."""
    kind = f"array<{dtypes.spark_type(n.dtype)}>"
    if isinstance(n, Leaf):
        return None if n.vectors is None else n.vectors.select("k", F.col("data").cast(kind).alias("data"))
    if isinstance(n, Scale) and (below := natural(n.child)) is not None:
        wide = "bigint" if kind == "array<bigint>" else "double"
        return below.select("k", F.transform("data", lambda x: x.cast(wide) * F.lit(n.scalar).cast(wide)).cast(kind).alias("data"))
    if isinstance(n, Add) and n.left is n.right and n.sign == 1 and (below := natural(n.left)) is not None:
        return below.select("k", F.transform("data", lambda x: x + x).cast(kind).alias("data"))
    return None


def rows_of(n: Node, visit, wide: str) -> DataFrame:
    """A node's rows as vectors of bigint or double: as they are, or put together from its cells."""
    found = natural(n)
    found = vectors.of_cells(visit(n), n.cols) if found is None else found
    return found.select("k", F.col("data").cast(f"array<{wide}>").alias("data"))


def method(n: MatMul) -> str:
    """inner: both sides of the result are thin; tall or wide: one is, and the other factor is small; blocks: many products and no thin side; else cells."""
    thin, inside = vectors.THIN, n.left.cols
    if max(n.rows, n.cols) <= thin:
        return "inner"
    if max(n.cols, inside) <= thin:
        return "tall"
    if max(n.rows, inside) <= thin:
        return "wide"
    return "blocks" if by_blocks(n) else "cells"


def by_blocks(n: MatMul) -> bool:
    """Whether a product multiplies blocks: only where cells would be many and no side is thin. Integers stay exact there, too."""
    return (n.dtype.startswith("float") or n.dtype == "int64") and n.rows * n.cols * n.left.cols > CELL_PRODUCTS and min(n.rows, n.cols) >= blocks.BLOCK
