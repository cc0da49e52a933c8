"""Block layout: rows (bi, bj, n_rows, n_cols, data) with row-major arrays, for products that are too large for cells.

A product multiplies whole blocks with NumPy inside Arrow batches. The result is dealt into super-blocks and the inner
dimension into slabs of SLAB blocks: a task gets at most 2 * SUPER * SLAB blocks however large the matrix, and hands on
the partial blocks of its super-block, which Spark adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SLAB = 8  # blocks of the inner dimension that meet in one task
SUPER = 8  # blocks a side of the result that one task makes, at most
SCHEMA = "bi long, bj long, n_rows int, n_cols int, data array<double>"
_NAMES = ["bi", "bj", "n_rows", "n_cols", "data"]


def to_blocks(cells: DataFrame, rows: int, cols: int, block: int = BLOCK, kind: str = "double") -> DataFrame:
    """Cells as blocks of float, double or bigint; those at the edge are smaller. A cell that a block lacks is 0."""
    bi, bj = F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj")
    down, across = F.least(F.lit(block), F.lit(rows) - F.col("bi") * block).cast("int"), F.least(F.lit(block), F.lit(cols) - F.col("bj") * block).cast("int")
    placed = cells.select(bi, bj, "i", "j", F.col("v").cast(kind).alias("v")).withColumns({"n_rows": down, "n_cols": across})
    at = ((F.col("i") - F.col("bi") * block) * F.col("n_cols") + F.col("j") - F.col("bj") * block).cast("int")
    placed = placed.select("bi", "bj", "n_rows", "n_cols", at.alias("at"), "v")
    element = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64()}[kind]
    return placed.groupBy("bi", "bj", "n_rows", "n_cols").applyInArrow(lambda key, table: _filled(key, table, element), _schema(kind))


def _filled(key: tuple[pa.Scalar, ...], table: pa.Table, element: pa.DataType) -> pa.Table:
    bi, bj, rows, cols = (k.as_py() for k in key)
    out = np.zeros((rows, cols), element.to_pandas_dtype())
    v = table.column("v").fill_null(0) if element == pa.int64() else table.column("v")
    out.ravel()[table.column("at").to_numpy()] = v.to_numpy()
    return _table([(bi, bj, out)], pa.list_(element))


def _schema(kind: str) -> str:
    return SCHEMA.replace("double", kind)


def to_cells(blocks: DataFrame, kind: str = "double", block: int = BLOCK) -> DataFrame:
    # The outer form, because for the inner one Spark infers a filter on the array's size, which repeats all that makes the
    # array, down to the joins, and an array read by places within a lambda is then made once for each place.
    flat = blocks.select("bi", "bj", "n_cols", F.posexplode_outer("data").alias("p", "v")).where("p IS NOT NULL")
    return flat.select((F.col("bi") * block + F.floor(F.col("p") / F.col("n_cols"))).alias("i"), (F.col("bj") * block + F.col("p") % F.col("n_cols")).cast("long").alias("j"), F.col("v").cast(kind).alias("v"))


def transpose(blocks: DataFrame) -> DataFrame:
    """Swaps the blocks' places and turns each block's data, in the JVM."""
    place = F.transform(F.sequence(F.lit(0), F.size("data") - 1), lambda p: F.get("data", (p % F.col("n_rows")) * F.col("n_cols") + F.floor(p / F.col("n_rows")).cast("int")))
    turned = blocks.select("bi", "bj", "n_rows", "n_cols", place.alias("turned"))  # a select of its own: names in a lambda would find the swapped columns
    return turned.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.col("n_cols").alias("n_rows"), F.col("n_rows").alias("n_cols"), F.col("turned").alias("data"))


def add(left: DataFrame, right: DataFrame) -> DataFrame:
    """The sum of blocks that both sides have; a table plus itself is read once."""
    if left is right:
        return left.withColumn("data", F.transform("data", lambda x: x + x))
    b = right.select("bi", "bj", F.col("data").alias("other"))
    return left.join(b, ["bi", "bj"]).select("bi", "bj", "n_rows", "n_cols", F.zip_with("data", "other", lambda x, y: x + y).alias("data"))


def scale(blocks: DataFrame, scalar: float) -> DataFrame:
    return blocks.withColumn("data", F.transform("data", lambda x: (x * F.lit(float(scalar))).cast(dict(blocks.dtypes)["data"][6:-1])))


def _arrays(table: pa.Table, names: tuple[str, ...]) -> dict[tuple, np.ndarray]:
    out = {}
    data = table.column("data").combine_chunks()
    keys = [table.column(n).to_pylist() for n in names]
    rows, cols = table.column("n_rows").to_pylist(), table.column("n_cols").to_pylist()
    for n, key in enumerate(zip(*keys)):
        out[key] = data[n].values.to_numpy(zero_copy_only=False).reshape(rows[n], cols[n])
    return out


def _joined(found: dict[tuple, np.ndarray], rows: list[int], cols: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """One array of all blocks, and where its block rows and columns begin and end. A block that is missing is 0."""
    height = {r: b.shape[0] for (r, _), b in found.items()}
    width = {c: b.shape[1] for (_, c), b in found.items()}
    down, across = np.cumsum([0, *(height[r] for r in rows)]), np.cumsum([0, *(width[c] for c in cols)])
    whole = next(iter(found.values())).dtype == np.int64
    out = np.zeros((down[-1], across[-1]), np.int64 if whole else np.float64)  # products of floats are summed in double, whatever the blocks' type
    row_at, col_at = {r: i for i, r in enumerate(rows)}, {c: j for j, c in enumerate(cols)}
    for (r, c), b in found.items():
        if r in row_at and c in col_at:
            i, j = row_at[r], col_at[c]
            out[down[i] : down[i + 1], across[j] : across[j + 1]] = b
    return out, down.tolist(), across.tolist()


def _multiply(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table, kind: pa.DataType) -> pa.Table:
    """All blocks of the result that lie in one super-block, over one slab: a single large product."""
    a, b = _arrays(left, ("bi", "k")), _arrays(right, ("k", "bj"))
    inner = sorted({k for _, k in a} & {k for k, _ in b})
    rows, cols, out = sorted({r for r, k in a if k in inner}), sorted({c for k, c in b if k in inner}), []
    if inner:
        x, down, _ = _joined(a, rows, inner)
        y, _, across = _joined(b, inner, cols)
        total = exact_product(x, y) if x.dtype == np.int64 else x @ y
        out = [(r, c, np.ascontiguousarray(total[down[i] : down[i + 1], across[j] : across[j + 1]])) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    return _table(out, kind).append_column("slab", pa.array([key[2].as_py()] * len(out), pa.int64()))


LIMB = 21  # bits: products of two limbs, summed over SLAB * BLOCK = 2 ** 11 places, stay below 2 ** 53


def exact_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of int64 with at most 2 ** 11 inner places, exact; OverflowError if a sum does not fit in int64.

    Values are three limbs of 21 bits, the highest one signed, so products of limbs are exact in double and run as fast
    as those of floats. Limbs that are 0 everywhere are left out. Carries go from the lowest place up.
    """
    if x.shape[1] > 1 << 53 - 2 * LIMB:
        raise ValueError("too many inner places for exact sums")
    mask = (1 << LIMB) - 1
    limbs = lambda m: [(k, part.astype(np.float64)) for k, part in enumerate((m & mask, m >> LIMB & mask, m >> 2 * LIMB)) if part.any()]
    places = [np.zeros((x.shape[0], y.shape[1]), np.int64) for _ in range(5)]
    right = limbs(y)
    for k, a in limbs(x):
        for m, b in right:
            places[k + m] += (a @ b).astype(np.int64)
    digits, carry = [], 0
    for place in places[:4]:
        place = place + carry
        digits.append(place & mask)
        carry = place >> LIMB
    top = places[4] + carry
    positive, negative = (top == 0) & (digits[3] == 0), (top == -1) & (digits[3] == mask)
    if not (positive | negative).all():
        raise OverflowError("a sum of products does not fit in int64")
    low = digits[0] + (digits[1] << LIMB) + (digits[2] << 2 * LIMB)
    return np.where(negative, low + np.iinfo(np.int64).min, low)


def exact_sum(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of arrays of int64; OverflowError if it does not fit on the way."""
    total = parts[0].copy()
    for x in parts[1:]:
        new = total + x
        if (((total ^ new) & (x ^ new)) < 0).any():
            raise OverflowError("a sum of products does not fit in int64")
        total = new
    return total


def _table(out: list[tuple[int, int, np.ndarray]], kind: pa.DataType) -> pa.Table:
    data = pa.array([x.ravel() for _, _, x in out], kind)
    cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), *(pa.array([o[2].shape[d] for o in out], pa.int32()) for d in (0, 1)), data]
    return pa.table(dict(zip(_NAMES, cols)))


def _sum_group(key: tuple[pa.Scalar, ...], table: pa.Table, kind: pa.DataType) -> pa.Table:
    """The sum of the partial blocks of one lot, in the order of their slabs: equal in every run."""
    table = table.sort_by("slab")
    data = table.column("data").combine_chunks()
    parts = [data[n].values.to_numpy(zero_copy_only=False) for n in range(len(data))]
    total = exact_sum(parts) if kind == pa.int64() else np.sum(parts, axis=0, dtype=np.float64)
    first = table.slice(0, 1)
    return pa.table({n: first.column(n) if n != "data" else pa.array([total], pa.list_(kind)) for n in _NAMES} | {"slab": pa.array([key[2].as_py()], pa.int64())})


def _summing(kind: pa.DataType):
    return lambda key, table: _sum_group(key, table, kind)


def side(down: int, across: int, slabs: int, cores: int) -> int:
    """Blocks a side of a super-block: as large as SUPER, but with at least two tasks a core where the result has so many blocks."""
    return max(1, min(SUPER, int((down * across * slabs / (2 * cores)) ** 0.5)))


def matmul(left: DataFrame, right: DataFrame, blocks_down: int, blocks_across: int, blocks_inner: int) -> DataFrame:
    """left @ right of blocks of one element type.

    A task makes a super-block of side x side blocks over one slab of the inner dimension, so a block is copied only once
    for each super-block of its row (or column). Partial results are added in rounds of SLAB until one is left. Floats are
    summed in double; bigint is exact, and a sum over a slab or over slabs, in their order, that does not fit raises.
    """
    slabs = -(-blocks_inner // SLAB)
    g = side(blocks_down, blocks_across, slabs, left.sparkSession.sparkContext.defaultParallelism)
    slab = lambda c: F.floor(F.col(c) / SLAB)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // g) - 1).cast("long")))
    a = left.select(F.floor(F.col("bi") / g).alias("row"), every(blocks_across).alias("col"), slab("bj").alias("slab"), "bi", F.col("bj").alias("k"), "n_rows", "n_cols", "data")
    b = right.select(every(blocks_down).alias("row"), F.floor(F.col("bj") / g).alias("col"), slab("bi").alias("slab"), F.col("bi").alias("k"), "bj", "n_rows", "n_cols", "data")
    kind = dict(left.dtypes)["data"][6:-1]
    final = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64()}[kind]
    between = final if kind == "bigint" else pa.float64()
    schema = lambda last: f"{_schema(kind if last or kind == 'bigint' else 'double')}, slab long"
    a, b = a.toDF(*a.columns), b.toDF(*b.columns)  # columns of their own, also where both sides are one table
    own = final if slabs == 1 else between
    part = a.groupBy("row", "col", "slab").cogroup(b.groupBy("row", "col", "slab")).applyInArrow(lambda k, x, y: _multiply(k, x, y, pa.list_(own)), schema(slabs == 1))
    while slabs > 1:
        slabs = -(-slabs // SLAB)
        own = final if slabs == 1 else between
        part = part.withColumn("lot", F.floor(F.col("slab") / SLAB)).groupBy("bi", "bj", "lot").applyInArrow(_summing(own), schema(slabs == 1))
    return part.drop("slab")
