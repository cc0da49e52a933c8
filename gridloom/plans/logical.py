"""What a lazy matrix stands for: a small tree over Spark DataFrames, checked as it is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridloom.plans import dtypes


class Node:
    """rows, cols and dtype of a matrix, and the nodes that it is made from."""

    rows: int
    cols: int
    dtype: str

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def inputs(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True, eq=False)
class Leaf(Node):
    """Cells (i, j, v) of a matrix, one row each; and, where its rows are at hand as arrays, the same as vectors (k, data)."""

    cells: DataFrame
    rows: int
    cols: int
    dtype: str
    vectors: DataFrame | None = None


@dataclass(frozen=True, eq=False)
class Add(Node):
    left: Node
    right: Node
    sign: int = 1

    def __post_init__(self):
        if self.left.shape != self.right.shape:
            raise ValueError(f"shapes {self.left.shape} and {self.right.shape} don't match for addition")

    rows = property(lambda self: self.left.rows)
    cols = property(lambda self: self.left.cols)
    dtype = property(lambda self: dtypes.promote(self.left.dtype, self.right.dtype))
    inputs = property(lambda self: (self.left, self.right))


@dataclass(frozen=True, eq=False)
class Scale(Node):
    child: Node
    scalar: float

    rows = property(lambda self: self.child.rows)
    cols = property(lambda self: self.child.cols)
    dtype = property(lambda self: dtypes.scaled(self.child.dtype, self.scalar))
    inputs = property(lambda self: (self.child,))


@dataclass(frozen=True, eq=False)
class MatMul(Node):
    left: Node
    right: Node

    def __post_init__(self):
        if self.left.cols != self.right.rows:
            raise ValueError(f"inner dimensions of {self.left.shape} and {self.right.shape} don't match")

    rows = property(lambda self: self.left.rows)
    cols = property(lambda self: self.right.cols)
    dtype = property(lambda self: dtypes.product(self.left.dtype, self.right.dtype))
    inputs = property(lambda self: (self.left, self.right))


@dataclass(frozen=True, eq=False)
class Transpose(Node):
    child: Node

    rows = property(lambda self: self.child.cols)
    cols = property(lambda self: self.child.rows)
    dtype = property(lambda self: self.child.dtype)
    inputs = property(lambda self: (self.child,))
