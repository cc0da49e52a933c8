"""The array API against NumPy: contracts, types, fused and plain forms, cells and blocks."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import api
from gridloom.operators import blocks
from gridloom.operators.cells import matmul
from gridloom.plans import dtypes
from gridloom.plans.logical import Add, Leaf, MatMul, Scale, Transpose
from gridloom.plans.lower import by_blocks
from gridloom.plans.rules import multiplications, nesting, pattern, rewrite

RNG = np.random.default_rng(42)


def made(spark, rows, cols, dtype="float32"):
    a = RNG.random((rows, cols)).astype(dtype) if dtype.startswith("float") else RNG.integers(-9, 9, (rows, cols)).astype(dtype)
    return a, api.array(spark, a, dtype)


def test_small_literals(spark):
    a, b = api.array(spark, [[1, 2], [3, 4]]), api.array(spark, [[5, 6], [7, 8]])
    assert (a + b).to_numpy().tolist() == [[6, 8], [10, 12]]
    assert ((a + b) * 2).to_numpy().tolist() == [[12, 16], [20, 24]]
    assert (a @ b).to_numpy().tolist() == [[19, 22], [43, 50]]
    assert (a - b).to_numpy().tolist() == [[-4, -4], [-4, -4]]
    assert (a @ b).dtype == np.float32
    assert a.shape == (2, 2) and a.ndim == 2 and a.size == 4
    assert api.dot(a, b).to_numpy().tolist() == [[19, 22], [43, 50]]
    assert api.add(a, b).to_numpy().tolist() == [[6, 8], [10, 12]] and api.multiply(a, 3).to_numpy().tolist() == [[3, 6], [9, 12]]


@pytest.mark.parametrize("shape", [(7, 5), (1, 9), (9, 1), (33, 17)])
def test_algebra_like_numpy(spark, shape):
    (x, a), (y, b), (z, c) = made(spark, *shape), made(spark, *shape), made(spark, shape[1], 6)
    np.testing.assert_allclose(((a + b) * 2.5).to_numpy(), (x + y) * np.float32(2.5), rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(((a + b) @ c).to_numpy(), (x + y) @ z, rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(((a @ c) * 0.5).to_numpy(), (x @ z) * np.float32(0.5), rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(((a * 2.0) * 3.5).to_numpy(), x * np.float32(7), rtol=1e-5)
    np.testing.assert_allclose((a @ c).T.to_numpy(), (x @ z).T, rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose((a + a).to_numpy(), x + x, rtol=1e-6)
    np.testing.assert_allclose(a.hadamard(b).to_numpy(), x * y, rtol=1e-5)
    np.testing.assert_allclose(a.plus(1.5).to_numpy(), x + np.float32(1.5), rtol=1e-5)
    np.testing.assert_allclose((-a / 4).to_numpy(), -x / 4, rtol=1e-5)


def test_errors(spark):
    a, b = api.ones(spark, (2, 3)), api.ones(spark, (2, 2))
    with pytest.raises(ValueError):
        a + b
    with pytest.raises(ValueError):
        a @ b @ a @ a
    with pytest.raises(NotImplementedError):
        a + 1
    with pytest.raises(TypeError):
        a + "x"
    with pytest.raises(NotImplementedError):
        a * a
    with pytest.raises(TypeError):
        a @ 3
    with pytest.raises(ValueError):
        api.array(spark, [1, 2, 3])
    with pytest.raises(TypeError):
        api.zeros(spark, (2, 2), "complex64")
    with pytest.raises(ValueError):
        api.zeros(spark, (-1, 2))


def test_types(spark):
    assert dtypes.promote("float32", "float64") == "float64" and dtypes.product("int32", "int32") == "int64" and dtypes.scaled("float32", 2.5) == "float32" and dtypes.scaled("int32", 0.5) == "float64"
    (x, a), (y, b) = made(spark, 5, 4, "int32"), made(spark, 5, 4, "float64")
    assert (a + b).dtype == np.float64 and np.allclose((a + b).to_numpy(), x + y)
    assert (a.T @ a).dtype == np.int64 and (a.T @ a).to_numpy().tolist() == (x.T.astype("int64") @ x).tolist()
    assert (a * 3).to_numpy().tolist() == (x * 3).tolist() and (a - a * 2).to_numpy().tolist() == (-x).tolist()
    v = api.array(spark, [[np.nan, np.inf]])
    assert np.isnan((v * 0).to_numpy()).all()


def test_constructors(spark):
    assert api.zeros(spark, (2, 3)).to_numpy().tolist() == [[0] * 3] * 2 and api.ones(spark, (2, 1)).to_numpy().tolist() == [[1], [1]]
    assert api.eye(spark, 3).to_numpy().tolist() == np.eye(3).tolist() and api.full(spark, (1, 2), 7, "int32").to_numpy().tolist() == [[7, 7]]
    r = api.random_rand(spark, (40, 30), seed=1).to_numpy()
    assert r.min() >= 0 and r.max() < 1 and 0.4 < r.mean() < 0.6
    assert (r == api.random_rand(spark, (40, 30), seed=1).to_numpy()).all() and (r != api.random_rand(spark, (40, 30), seed=2).to_numpy()).any()
    assert api.zeros(spark, (0, 3)).to_numpy().shape == (0, 3)


def test_eye_query_has_the_size_of_the_table(spark):
    from gridloom import queries

    sf = "/root/testdata/sf0.1"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.max("l_suppkey") + 1).first()[0]
    found = queries.mat_eye(spark, sf).agg(F.count(F.lit(1)), F.max("i"), F.max("j"), F.sum("v"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0))).first()
    assert n > 500 and tuple(found) == (n * n, n - 1, n - 1, n, n)


def test_block_algebra_makes_arrays_once(spark):
    """Sum, scaling and turn of blocks, read as cells: no filter or join repeats the arrays that they make, and a table plus itself is made once."""
    x, m = made(spark, 23, 10, "float64")
    b = blocks.to_blocks(m.cells, *m.shape, 4)
    other = blocks.to_blocks((m * 3.0).cells, *m.shape, 4)
    for total, want, sides in ((blocks.add(b, b), x * 2, 1), (blocks.add(b, other), x * 4, 2)):
        cells = blocks.to_cells(blocks.transpose(blocks.scale(total, 2.0)), block=4)
        np.testing.assert_allclose(api.Matrix(Leaf(cells, 10, 23, "float64")).to_numpy(), want.T * 2)
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        assert "size(transform(" not in plan and plan.count("FlatMapGroupsInArrow") == sides


def test_made_cells_come_in_bands(spark, folder, monkeypatch):
    """A wide matrix is written small (32 MB row by row), and strips and bands of any size have each place once."""
    api.zeros(spark, (200, 40_000)).cells.write.parquet(f"{folder}/wide")
    assert sum(f.stat().st_size for f in pathlib.Path(f"{folder}/wide").glob("*.parquet")) < 4_000_000
    assert tuple(spark.read.parquet(f"{folder}/wide").agg(F.count(F.lit(1)), F.countDistinct(F.col("i") * 40_000 + F.col("j")), F.max("i"), F.max("j")).first()) == (8_000_000, 8_000_000, 199, 39_999)
    monkeypatch.setattr(api, "STRIP", 8)
    monkeypatch.setattr(api, "BAND", 3)
    for shape in ((19, 10), (16, 9), (1, 9), (9, 1), (0, 4), (4, 0)):
        assert sorted((r.i, r.j) for r in api.ones(spark, shape).cells.collect()) == [(i, j) for i in range(shape[0]) for j in range(shape[1])]
    assert api.eye(spark, 20).to_numpy().tolist() == np.eye(20).tolist()


def test_made_cells_come_in_bounded_tasks_without_costly_divisions(spark, folder):
    """A large matrix is dealt to many tasks, an index takes divisions by literals only, is never null, and is written small where 512 does not divide the columns."""
    from gridloom import queries

    m = api.eye(spark, 360_000)
    assert m.cells.rdd.getNumPartitions() >= 360_000**2 // (api.STRIP * api.BAND) and api.ones(spark, (100_000_000, 100_000_000)).cells.rdd.getNumPartitions() <= api.MAKERS + spark.sparkContext.defaultParallelism
    assert not any(f.nullable for f in queries.mat_eye(spark, "/root/testdata/sf0.001").schema)
    plan = m.cells._jdf.queryExecution().optimizedPlan().toString()
    assert " div " in plan and all(part.lstrip()[0].isdigit() for part in plan.split(" div ")[1:]) and "least(" not in plan
    made = api.zeros(spark, (9_000, 1_020)).cells
    made.write.parquet(f"{folder}/odd")
    assert sum(f.stat().st_size for f in pathlib.Path(f"{folder}/odd").glob("*.parquet")) < 2_500_000
    assert tuple(spark.read.parquet(f"{folder}/odd").agg(F.count(F.lit(1)), F.countDistinct(F.col("i") * 1_020 + F.col("j")), F.max("i"), F.max("j"), F.min("j")).first()) == (9_180_000, 9_180_000, 8_999, 1_019, 0)


def test_tiles_and_reductions(spark):
    x, a = made(spark, 20, 9)
    np.testing.assert_allclose(a.tile(15, 4, 10, 10).to_numpy(), x[15:, 4:])
    assert a.tile(30, 0, 4, 4).shape == (0, 4)
    assert abs(a.reduce("sum").first()[0] - x.sum()) < 1e-3
    assert {r.j: round(r.v, 4) for r in a.reduce("mean", 0).collect()} == {j: round(float(m), 4) for j, m in enumerate(x.astype("float64").mean(0))}
    assert {r.i: r.v for r in a.reduce("max", 1).collect()} == {i: m for i, m in enumerate(x.max(1))}
    np.testing.assert_allclose(a.correlation().to_numpy(), np.corrcoef(x.T), atol=1e-6)


def test_rewrites(spark):
    leaf = lambda n, m: Leaf(None, n, m, "float32")
    a, b, c = leaf(3, 4), leaf(3, 4), leaf(4, 5)
    two = rewrite(Scale(Scale(a, 2.0), 3.0))
    assert isinstance(two, Scale) and two.scalar == 6.0 and two.child is a
    assert rewrite(Transpose(Transpose(a))) is a and rewrite(Scale(a, 1)) is a
    t = rewrite(Transpose(MatMul(Add(a, b), c)))
    assert isinstance(t, MatMul) and t.shape == (5, 3) and isinstance(t.right, Add)
    assert pattern(Scale(Add(a, b), 2)) == "add-scale" and pattern(Scale(MatMul(a, c), 2)) == "matmul-scale" and pattern(MatMul(Add(a, b), c)) == "add-matmul" and pattern(a) is None
    report = ((api.ones(spark, (2048, 2048)) + api.ones(spark, (2048, 2048))) * 2.5).report()
    assert report["pattern"] == "add-scale" and report["cost"] == {"io_ops": 8, "compute_ops": 8, "memory_bytes": 33_554_432, "cache_benefit": 0.3, "total": 808}


def test_plans_have_no_extra_steps(spark):
    """Scaling a sum adds no shuffle, and a self-sum none at all; scaled products fold into the aggregate."""
    a, b = api.random_rand(spark, (50, 40)), api.random_rand(spark, (50, 40), seed=3)
    plan = lambda m: m.cells._jdf.queryExecution().executedPlan().toString()
    assert plan((a + b) * 2.0).count("Exchange") == plan(a + b).count("Exchange")
    assert "Exchange" not in plan((a + a) * 2.0 * 3.0)
    assert plan((a.T @ b) * 2.0).count("HashAggregate") == plan(a.T @ b).count("HashAggregate")


@pytest.mark.parametrize("shape", [(10, 7, 5), (9, 20, 4), (8, 8, 8)])
def test_blocks_like_cells(spark, shape):
    n, k, m = shape
    (x, a), (y, b) = made(spark, n, k, "float64"), made(spark, k, m, "float64")
    left, right = blocks.to_blocks(a.cells, n, k, 4), blocks.to_blocks(b.cells, k, m, 4)
    up = lambda z: -(-z // 4)
    product = blocks.to_cells(blocks.matmul(left, right, up(n), up(m), up(k)), block=4)
    got = api.Matrix(Leaf(product, n, m, "float64")).to_numpy()
    np.testing.assert_allclose(got, x @ y)
    turned = api.Matrix(Leaf(blocks.to_cells(blocks.transpose(left), block=4), k, n, "float64")).to_numpy()
    assert (turned == x.T).all()
    twice = api.Matrix(Leaf(blocks.to_cells(blocks.scale(blocks.add(left, left), 0.5), block=4), n, k, "float64")).to_numpy()
    np.testing.assert_allclose(twice, x)
    shuffled = matmul(a.cells, b.cells, "double", 10**9, 10**9)
    np.testing.assert_allclose(api.Matrix(Leaf(shuffled, n, m, "float64")).to_numpy(), x @ y)


def test_large_products_use_blocks(spark):
    (x, a), (y, b) = made(spark, 600, 700), made(spark, 700, 600)
    assert by_blocks((a @ b).node) and not by_blocks((a @ api.ones(spark, (700, 3))).node)
    np.testing.assert_allclose((a @ b).to_numpy(), x @ y, rtol=1e-4, atol=1e-4)


def test_compute_and_limits(spark, folder):
    x, a = made(spark, 6, 5)
    kept = (a * 2).compute()
    assert isinstance(kept.node, Leaf) and np.allclose(kept.to_numpy(), x * 2)
    stored = a.compute(f"{folder}/m")
    assert np.allclose(stored.to_numpy(), x) and stored.dtype == np.float32
    with pytest.raises(ValueError):
        api.zeros(spark, (10**5, 10**5)).to_numpy()
    assert F is not None


def test_square_of_one_table_over_several_slabs(spark, monkeypatch):
    """A = B in blocks of float32, with super-blocks and more than one slab."""
    monkeypatch.setattr(blocks, "side", lambda *args: 3)
    x = np.random.default_rng(5).random((78, 78)).astype("float32")
    cells = blocks.to_blocks(api.array(spark, x).cells, 78, 78, 4, "float")
    product = blocks.matmul(cells, cells, 20, 20, 20)
    assert dict(product.dtypes)["data"] == "array<float>"
    got = api.Matrix(Leaf(blocks.to_cells(product, "float", 4), 78, 78, "float32")).to_numpy()
    np.testing.assert_allclose(got, x @ x, rtol=1e-4)


def test_missing_cells_count_as_zero(spark):
    """Whatever the element type; logical matrices add as "or"."""
    for kind, values in (("double", (1.5, 2.0)), ("long", (1, 2)), ("boolean", (True, True))):
        a = api.Matrix.from_cells(spark.createDataFrame([(0, 0, values[0])], f"i long, j long, v {kind}"), 1, 2)
        b = api.Matrix.from_cells(spark.createDataFrame([(0, 1, values[1])], f"i long, j long, v {kind}"), 1, 2)
        assert (a + b).to_numpy().tolist() == [list(values)]


# ---- Thin products, order of chains, shared subtrees, block sums


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_thin_products(spark):
    """Like NumPy on rows at hand and on cells, with missing cells, short rows and all element types; no join of cells."""
    rng = np.random.default_rng(8)
    x, y = rng.random((900, 7)), rng.random((900, 5))
    rows = lambda z: spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(z)], "k long, data array<double>")
    a, b = api.Matrix.from_vectors(rows(x), 900, 7, "float64"), api.array(spark, y, "float64")
    for product, want in ((a.T @ a, x.T @ x), (a.T @ b, x.T @ y), ((a + a).T @ b * 0.5, x.T @ y), (((a * 2.0).T @ a), 2 * x.T @ x), (a @ (a.T @ b), x @ (x.T @ y)), ((a.T @ b).T @ a.T, (x.T @ y).T @ x.T)):
        np.testing.assert_allclose(product.to_numpy(), want, rtol=1e-9)
        assert "ArrowEvalPython" not in plan_of(product.cells)
    assert not {"SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"} & set(plan_of((a.T @ a).cells).replace("(", " ").split())
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, []), (3, [None, 4.0])], "k long, data array<double>")
    s = api.Matrix.from_vectors(short.where("k < 3"), 3, 2, "float64")
    assert (s.T @ s).to_numpy().tolist() == [[10, 2], [2, 4]]
    holes = api.Matrix.from_cells(spark.createDataFrame([(0, 1, 2), (4, 0, 3), (4, 1, 1)], "i long, j long, v int"), 6, 2)
    assert (holes.T @ holes).to_numpy().tolist() == [[9, 3], [3, 5]] and (holes.T @ holes).dtype == np.int64
    assert (holes @ holes.T).to_numpy()[4].tolist() == [2, 0, 0, 0, 10, 0]
    assert (a.T @ a).node.dtype == "float64" and (api.ones(spark, (700, 2)).T @ api.ones(spark, (700, 2))).dtype == np.float32


def test_thin_products_of_integers_are_exact_or_raise(spark):
    x = np.array([[2**31 - 1, 3], [2**31 - 5, -7]] * 2, "int64")
    a = api.array(spark, x, "int64")
    with pytest.raises(Exception, match="64 bits"):
        (a.T @ a).to_numpy()
    b = api.array(spark, x[:1], "int64")
    assert (b.T @ b).to_numpy().tolist() == [[(2**31 - 1) ** 2, 3 * (2**31 - 1)], [3 * (2**31 - 1), 9]]


def test_gram_of_a_million_rows_exchanges_small_matrices(spark):
    """10^6 x 64: what is exchanged is one 64 x 64 matrix a task."""
    data = spark.range(1_000_000, numPartitions=8).select(F.col("id").alias("k"), F.array_repeat((F.col("id") % 3).cast("double"), 64).alias("data"))
    m = api.Matrix.from_vectors(data, 1_000_000, 64, "float64")
    product = (m.T @ m).cells
    got = product.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    want = sum((k % 3) ** 2 for k in range(3)) * 333_333 + 0
    assert tuple(got) == (4096, float(want), float(want))
    plan = plan_of(product)
    assert plan.count("Exchange hashpartitioning(i") == 1 and "Join" not in plan and "Generate" not in plan


def test_order_of_chains(spark):
    leaf = lambda n, m, kind="float32": Leaf(spark.range(0), n, m, kind)
    tall = leaf(1000, 8)
    wrong = rewrite(MatMul(MatMul(tall, Transpose(tall)), tall))
    right = rewrite(MatMul(tall, MatMul(Transpose(tall), tall)))
    assert isinstance(wrong.right, MatMul) and wrong.left is tall and isinstance(right.right, MatMul)
    assert nesting(wrong) == nesting(right) == "(1000x8 @ (8x1000 @ 1000x8))"
    assert multiplications(wrong) == 2 * 8 * 1000 * 8
    ints = leaf(1000, 8, "int64")
    assert isinstance(rewrite(MatMul(MatMul(ints, Transpose(ints)), ints)).left, MatMul)
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 30, rng.integers(3, 7)).tolist()
        chain = [leaf(a, b) for a, b in zip(sizes, sizes[1:])]

        def least(lo, hi):
            return 0 if lo == hi else min(least(lo, k) + least(k + 1, hi) + sizes[lo] * sizes[k + 1] * sizes[hi + 1] for k in range(lo, hi))

        nested = chain[0]
        for m in chain[1:]:
            nested = MatMul(nested, m)
        assert multiplications(rewrite(nested)) == least(0, len(chain) - 1)
    x = rng.random((40, 3)).astype("float32")
    a = api.array(spark, x)
    np.testing.assert_allclose(((a @ a.T) @ a).to_numpy(), x @ x.T @ x, rtol=1e-4)
    report = ((a @ a.T) @ a).report()
    assert report["order"] == "(40x3 @ (3x40 @ 40x3))" and report["multiplications"] == 720 and report["method"] in ("inner", "tall")


def test_equal_subtrees_are_one(spark, monkeypatch):
    from gridloom.plans import lower as lowering

    x = np.random.default_rng(3).random((30, 30)).astype("float32")
    a, b = api.array(spark, x), api.array(spark, x.T.copy())
    twice = rewrite(Add(MatMul(a.node, b.node), MatMul(a.node, b.node)))
    assert twice.left is twice.right
    written = []
    monkeypatch.setattr(lowering, "materialise", lambda df, name: written.append(name) or df)
    assert plan_of(((a @ b) + (a @ b)).cells).count("MapInArrow") == 1 and not written
    p = a @ b
    three = (p + p.T * 2) @ (a @ b)
    np.testing.assert_allclose(three.to_numpy(), (x @ x.T + 2 * (x @ x.T).T) @ (x @ x.T), rtol=1e-4)
    assert written == ["shared-product"]


def test_match_has_its_parameters(spark):
    a, b = api.ones(spark, (4, 3)), api.zeros(spark, (4, 3))
    assert ((a + b) * 2.5).report()["match"] == {"name": "add-scale", "inputs": [(4, 3), (4, 3)], "scalars": [2.5]}
    assert ((a + b) @ api.ones(spark, (3, 2))).report()["match"] == {"name": "add-matmul", "inputs": [(4, 3), (4, 3), (3, 2)], "scalars": []}
    assert a.report()["match"] is None


def test_block_sums_follow_the_slabs(spark, monkeypatch):
    """Partial blocks are dealt and added by slab, in double: float32 results are those of double, rounded once, in any partitioning."""
    x = np.random.default_rng(5).random((8, 4 * 8 * 9)).astype("float32")
    left = blocks.to_blocks(api.array(spark, x).cells, *x.shape, 4, "float")
    right = blocks.transpose(left)
    want = (x.astype("float64") @ x.T.astype("float64")).astype("float32")
    for parts in (1, 7):
        product = blocks.matmul(left.repartition(parts), right.repartition(parts + 2), 2, 2, 72)
        got = api.Matrix(Leaf(blocks.to_cells(product, "float", 4), 8, 8, "float32")).to_numpy()
        np.testing.assert_allclose(got, want, rtol=2e-7)
    same = blocks.to_blocks(api.ones(spark, (4, 4 * 8 * 9)).cells, 4, 288, 4, "float")
    product = blocks.matmul(same, blocks.transpose(same), 1, 1, 72)
    assert set(api.Matrix(Leaf(blocks.to_cells(product, "float", 4), 4, 4, "float32")).to_numpy().ravel()) == {288.0}


def test_exact_products_of_integers():
    top, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    for bound in (9, 2**21, 2**26):
        x, y = RNG.integers(-bound, bound, (7, 2048)), RNG.integers(-bound, bound, (2048, 5))
        assert (blocks.exact_product(x, y) == x @ y).all()
    one = np.ones((1, 1), np.int64)
    for v in (top, low, top - 2**42, -1, 0, 1 << 62, -(1 << 62)):
        assert blocks.exact_product(one * v, one)[0, 0] == v
    # What does not fit on the way, but does in the end.
    assert blocks.exact_product(np.array([[top, top, low, low, 2]]), np.ones((5, 1), np.int64))[0, 0] == 0
    for x, y in (([[top, 1]], [[1], [1]]), ([[low, -1]], [[1], [1]]), ([[low]], [[-1]]), ([[2**40]], [[2**40]]), ([[top]], [[top]])):
        with pytest.raises(OverflowError):
            blocks.exact_product(np.array(x), np.array(y))
    assert blocks.exact_sum([np.array([top]), np.array([low]), np.array([5])]).tolist() == [4]
    with pytest.raises(OverflowError):
        blocks.exact_sum([np.array([top]), np.array([1])])


def test_integer_blocks(spark):
    """Several slabs of blocks of integers, with cells that are missing, against NumPy; overflow raises."""
    x, y = RNG.integers(-(2**28), 2**28, (9, 75)), RNG.integers(-(2**27), 2**27, (75, 10))
    x[RNG.random(x.shape) < 0.2] = 0
    left = blocks.to_blocks(api.array(spark, x, "int64").cells.where("v <> 0"), *x.shape, 4, "bigint")
    right = blocks.to_blocks(api.array(spark, y, "int64").cells, *y.shape, 4, "bigint")
    product = blocks.matmul(left, right, 3, 3, 19)
    got = api.Matrix(Leaf(blocks.to_cells(product, "bigint", 4), 9, 10, "int64")).to_numpy()
    assert got.dtype == np.int64 and (got == x @ y).all()
    big = api.array(spark, np.full((4, 75), 2**31), "int64")
    side = lambda m, kind: blocks.to_blocks(m.cells, *m.shape, 4, kind)
    with pytest.raises(Exception, match="does not fit"):
        blocks.matmul(side(big, "bigint"), side(big.T, "bigint"), 1, 1, 19).collect()
    a, b = (api.Matrix(Leaf(spark.range(0).selectExpr("id AS i", "id AS j", f"CAST(0 AS {k}) AS v"), 2000, 2000, d)) for k, d in (("int", "int32"), ("bigint", "int64")))
    assert by_blocks((a @ b).node) and by_blocks((a @ a).node)


def test_large_integer_product_by_blocks(spark):
    """600 x 600 x 600 of int32 goes by blocks and widens to int64."""
    x, y = (RNG.integers(-(2**31), 2**31, (600, 600)).astype("int32") // 64 for _ in "xy")
    a, b = (api.Matrix(Leaf(spark.createDataFrame(spark_cells(m)), 600, 600, "int32")) for m in (x, y))
    assert by_blocks((a @ b).node)
    assert ((a @ b).to_numpy() == x.astype(np.int64) @ y.astype(np.int64)).all()


def spark_cells(m):
    import pandas as pd

    i, j = np.indices(m.shape)
    return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": m.ravel()})
