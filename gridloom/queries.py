"""The registered queries over the given tables, each with its SQL where SQL can say the same.

E is the embeddings as a matrix (vec_id x position), L the summed quantities of lineitem (supplier x line number).
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api
from gridloom.api import Matrix
from gridloom.functions import cache_stats as stats
from gridloom.functions import stack_distance, working_set
from gridloom.operators import blocks
from gridloom.plans import cost
from gridloom.plans.logical import Leaf
from gridloom.sources import datagen, files
from gridloom.sources.shared import read_table, shared_path

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
CAPACITY = 64  # tiles of the cache in the event queries
TILE = 16  # of the access queries: small tables have several such tiles

_E = "E AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(p - 1 AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"
_L = "L AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) - 1 AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
_G = "G AS (SELECT a.j AS i, b.j AS j, SUM(a.v * b.v) AS v FROM E a JOIN E b ON a.i = b.i GROUP BY 1, 2)"
_LOG = """log AS (SELECT ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS seq, ts, CASE event_type WHEN 'error' THEN 'EVICT' WHEN 'signup' THEN 'MISS' ELSE 'HIT' END AS event_type,
    CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS matrix, (user_id // 16) % 8 AS r, (user_id // 2) % 8 AS c, user_id AS tile, event_id % 64 AS cache_len FROM events)"""
_ACCESS = "acc AS (SELECT * FROM log WHERE event_type IN ('HIT', 'MISS'))"
_REUSE = "reuse AS (SELECT * FROM (SELECT seq, tile, seq - LAG(seq) OVER (PARTITION BY tile ORDER BY seq) AS distance FROM acc) WHERE distance IS NOT NULL)"


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle is not None:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    table = read_table(spark, sf_dir, "embeddings")
    size = table.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return Matrix.from_vectors(table.select(F.col("vec_id").cast("long").alias("k"), F.col("embedding").cast("array<double>").alias("data")), int(size[0]), int(size[1]), "float64")


def quantities(spark: SparkSession, sf_dir: str) -> Matrix:
    cells = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("i"), (F.col("l_linenumber").cast("long") - 1).alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    size = read_table(spark, sf_dir, "lineitem").agg(F.coalesce(F.max("l_suppkey") + 1, F.lit(0)), F.coalesce(F.max("l_linenumber"), F.lit(0))).first()
    return Matrix(Leaf(cells, int(size[0]), int(size[1]), "int64"))


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.event_log(read_table(spark, sf_dir, "events"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ---- Algebra


@query(f"WITH {_E} SELECT i, j, ROUND(v + v, 6) + 0.0 AS v FROM E")
def mat_add(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e + Matrix(e.node)).cells, "v")


@query(f"WITH {_E} SELECT a.i, a.j, ROUND(a.v + b.v * 0.5, 6) + 0.0 AS v FROM E a JOIN E b ON a.i = b.i AND a.j = b.j")
def mat_add_join(spark, sf_dir):
    return rounded((embeddings(spark, sf_dir) + embeddings(spark, sf_dir) * 0.5).cells, "v")


@query(f"WITH {_L} SELECT i, j, v + v * 3 AS v FROM L")
def mat_add_int(spark, sf_dir):
    m = quantities(spark, sf_dir)
    return (m + m * 3).cells


@query(f"WITH {_L} SELECT i, j, v - 2 * v AS v FROM L")
def mat_subtract(spark, sf_dir):
    m = quantities(spark, sf_dir)
    return (m - 2 * m).cells


@query(f"WITH {_E} SELECT i, j, ROUND(v * CAST(2.5 AS DOUBLE), 6) + 0.0 AS v FROM E")
def mat_scale(spark, sf_dir):
    return rounded((embeddings(spark, sf_dir) * 2.5).cells, "v")


@query(f"WITH {_E} SELECT i, j, ROUND(CAST(0.25 AS DOUBLE) * v, 6) + 0.0 AS v FROM E")
def mat_rscale(spark, sf_dir):
    return rounded((0.25 * embeddings(spark, sf_dir)).cells, "v")


@query(f"WITH {_E} SELECT i, j, ROUND((v + v) * CAST(2.5 AS DOUBLE), 6) + 0.0 AS v FROM E")
def mat_add_scale_fused(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(((e + e) * 2.5).cells, "v")


@query(f"WITH {_E} SELECT i, j, ROUND(v * CAST(7 AS DOUBLE), 6) + 0.0 AS v FROM E")
def mat_double_scale(spark, sf_dir):
    return rounded(((embeddings(spark, sf_dir) * 2.0) * 3.5).cells, "v")


@query(f"WITH {_L} SELECT a.j AS i, b.j AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM L a JOIN L b ON a.i = b.i GROUP BY 1, 2")
def mat_matmul_int(spark, sf_dir):
    m = quantities(spark, sf_dir)
    return (m.T @ m).cells


@query(f"WITH {_E}, {_G} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM G")
def mat_gram(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e.T @ e).cells, "v")


@query(f"WITH {_L} SELECT a.j AS i, b.j AS j, CAST(6 * SUM(a.v * b.v) AS BIGINT) AS v FROM L a JOIN L b ON a.i = b.i GROUP BY 1, 2")
def mat_function_forms(spark, sf_dir):
    """dot, add and multiply as functions, computed into native files and read back."""
    m = quantities(spark, sf_dir)
    square = api.dot(m.T, m)
    return api.multiply(api.add(square, api.dot(m.T, m)), 3).compute(shared_path(spark, "forms")).cells


@query(f"WITH {_E}, {_G} SELECT E.i, G.j, ROUND(SUM(E.v * G.v), 5) + 0.0 AS v FROM E JOIN G ON E.j = G.i GROUP BY 1, 2")
def mat_matmul_chain(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e @ (e.T @ e)).cells, "v", digits=5)


@query(f"WITH {_E}, {_G} SELECT E.i, G.j, ROUND(SUM(E.v * G.v), 5) + 0.0 AS v FROM E JOIN G ON E.j = G.i GROUP BY 1, 2")
def mat_chain_order(spark, sf_dir):
    """(E @ E.T) @ E without the square of the number of rows on the way."""
    e = embeddings(spark, sf_dir)
    return rounded(((e @ e.T) @ e).cells, "v", digits=5)


@query(f"WITH {_E}, {_G}, P AS (SELECT i, j, v / (SELECT MAX(i) + 1 FROM E) AS v FROM G), Q AS (SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM P a JOIN P b ON a.j = b.i GROUP BY 1, 2) SELECT P.i, P.j, ROUND(P.v + Q.v, 5) + 0.0 AS v FROM P JOIN Q ON P.i = Q.i AND P.j = Q.j")
def mat_shared_product(spark, sf_dir):
    """P + P @ P of the mean product P of the columns: written twice in the expression, computed once."""
    e = embeddings(spark, sf_dir)
    share = 1.0 / e.shape[0]
    return rounded(((e.T @ e) * share + ((e.T @ e) * share) @ ((e.T @ e) * share)).cells, "v", digits=5)


@query(f"WITH {_E}, {_G} SELECT i, j, ROUND(v * CAST(0.5 AS DOUBLE), 6) + 0.0 AS v FROM G")
def mat_matmul_scale(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(((e.T @ e) * 0.5).cells, "v")


@query(f"WITH {_E}, {_G} SELECT i, j, ROUND(2 * v, 6) + 0.0 AS v FROM G")
def mat_add_matmul(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(((e.T + e.T) @ e).cells, "v")


@query(f"WITH {_E} SELECT j AS i, i AS j, ROUND(v, 6) + 0.0 AS v FROM E")
def mat_transpose(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).T.cells, "v")


@query(f"WITH {_L}, P AS (SELECT a.j AS i, b.j AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM L a JOIN L b ON a.i = b.i GROUP BY 1, 2) SELECT j AS i, i AS j, v * 2 AS v FROM P")
def mat_transpose_product(spark, sf_dir):
    m = quantities(spark, sf_dir)
    return ((m.T @ m) * 2).T.cells


@query(f"WITH {_E} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM E")
def mat_eye_matmul(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e @ api.eye(spark, e.shape[1], "float64")).cells, "v")


@query(f"WITH {_L} SELECT i, j, v * v AS v FROM L")
def mat_hadamard(spark, sf_dir):
    m = quantities(spark, sf_dir)
    return m.hadamard(m).cells


@query(f"WITH {_E} SELECT j, ROUND(AVG(v), 9) + 0.0 AS v FROM E GROUP BY j")
def mat_column_means(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).reduce("mean", 0), "v", digits=9)


@query(f"WITH {_L} SELECT i, CAST(SUM(v) AS BIGINT) AS v FROM L GROUP BY i")
def mat_row_sums(spark, sf_dir):
    return quantities(spark, sf_dir).reduce("sum", 1)


@query(f"""WITH {_E}, S AS (SELECT j, AVG(v) AS m, STDDEV_POP(v) AS s FROM E GROUP BY j), Z AS (SELECT E.i, E.j, (E.v - m) / s AS v FROM E JOIN S ON E.j = S.j)
    SELECT a.j AS i, b.j AS j, ROUND(AVG(a.v * b.v), 6) + 0.0 AS v FROM Z a JOIN Z b ON a.i = b.i GROUP BY 1, 2""")
def mat_correlation(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).correlation().cells, "v")


# ---- Sources, constructors, checks


def _filled(value: str) -> str:
    return f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST({value} AS FLOAT) AS v FROM (SELECT unnest(range(0, (SELECT MAX(l_suppkey) + 1 FROM lineitem))) AS i) CROSS JOIN (SELECT unnest(range(0, (SELECT MAX(l_linenumber) FROM lineitem))) AS j)"


@query(f"WITH {_E} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM E")
def mat_zeros(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e + api.zeros(spark, e.shape, "float64")).cells, "v")


@query(f"WITH {_E} SELECT i, j, ROUND(v + 1, 6) + 0.0 AS v FROM E")
def mat_ones(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded((e + api.ones(spark, e.shape, "float64")).cells, "v")


@query(_filled("CASE WHEN i = j THEN 1 ELSE 0 END").replace("MAX(l_linenumber)", "MAX(l_suppkey) + 1"))
def mat_eye(spark, sf_dir):
    return api.eye(spark, quantities(spark, sf_dir).shape[0]).cells


def _sql_uniform(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


@query(f"WITH {_E} SELECT i, j, ROUND(v * (FLOOR({_sql_uniform(7, 'i', 'j')} * 16777216) / CAST(16777216 AS DOUBLE)), 6) + 0.0 AS v FROM E")
def mat_random(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(e.hadamard(api.random_rand(spark, e.shape, seed=7)).cells, "v")


def _sql_normal(seed: int, *parts: str) -> str:
    return f"(SQRT(-2 * LN(1 - {_sql_uniform(seed, *parts)})) * COS(CAST(6.283185307179586 AS DOUBLE) * {_sql_uniform(seed + 1, *parts)}))"


@query(f"WITH {_E} SELECT i, j, ROUND(v * GREATEST(EXP(2.0 + 1.5 * {_sql_normal(42, 'i', 'j')}) + 0.3 * {_sql_normal(44, 'i // 100', 'j')}, 0), 6) + 0.0 AS v FROM E")
def mat_gene_expression(spark, sf_dir):
    """Each element of E scaled by the expression value of its place."""
    cells = embeddings(spark, sf_dir).cells
    return rounded(cells.select("i", "j", (F.col("v") * datagen.expression(F.col("i"), F.col("j"), 42)).alias("v")), "v")


@query("SELECT CAST(vec_id AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(label AS INTEGER) AS v FROM embeddings")
def source_array(spark, sf_dir):
    """A matrix from rows of a table: constructor, element type of the column, save and load in the native form."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.col("label").cast("int").alias("v"))
    m = Matrix.from_cells(table, int(table.agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]), 1)
    files.save(path := shared_path(spark, "native"), m)
    return files.load(spark, path).cells


def _mounted(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder as an ordinary path: tasks and driver open it by themselves."""
    path = shared_path(spark, name)
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} can't be opened as a file")
    path = re.sub("^file:/+", "/", path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


@query(f"WITH {_E} SELECT i, j, CAST(v AS FLOAT) AS v FROM E")
def source_raw(spark, sf_dir):
    """E to one raw row-major file of float32 and back."""
    e = embeddings(spark, sf_dir)
    single = Matrix(Leaf(e.cells.withColumn("v", F.col("v").cast("float")), *e.shape, "float32"))
    files.save_file(path := _mounted(spark, "raw.dat"), single)
    return files.load(spark, path, e.shape, "float32").cells


@query(f"WITH {_E} SELECT i, j, v FROM E")
def source_npy(spark, sf_dir):
    """E to one .npy file, converted to the native form and read again."""
    files.save_file(path := _mounted(spark, "e.npy"), embeddings(spark, sf_dir))
    target, _ = files.convert(spark, path, shared_path(spark, "converted"), dtype="float64")
    return files.load(spark, target).cells


@query(f"WITH {_L} SELECT i, j, v FROM L")
def source_parts(spark, sf_dir):
    """L, filled up with zeros, to a folder of raw parts of int64 and back; what was missing is left out again."""
    m = quantities(spark, sf_dir)
    files.save_raw(path := shared_path(spark, "parts"), m + api.zeros(spark, m.shape, "int64"))
    known = m.cells.select("i", "j")
    return files.load(spark, path, m.shape, "int64").cells.join(known, ["i", "j"], "left_semi")


@query(f"WITH {_E} SELECT i, j, CAST(v AS FLOAT) AS v FROM E WHERE i BETWEEN 128 AND 383 AND j < 16")
def source_binary(spark, sf_dir):
    """E to a raw file, converted to the native form, and a rectangle of that."""
    e = embeddings(spark, sf_dir)
    files.save_file(path := _mounted(spark, "e.bin"), Matrix(Leaf(e.cells.withColumn("v", F.col("v").cast("float")), *e.shape, "float32")))
    target, _ = files.convert(spark, path, shared_path(spark, "from-binary"), shape=e.shape)
    return files.load(spark, target).cells.where("i BETWEEN 128 AND 383 AND j < 16")


@query(f"WITH {_E} SELECT i, j, CAST(v AS FLOAT) AS v FROM E")
def source_csv(spark, sf_dir):
    """E as a folder of CSV files, in the order of their names, and back."""
    table = read_table(spark, sf_dir, "embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    table.select(F.concat_ws(",", F.transform("embedding", lambda v: v.cast("string")))).write.text(path := shared_path(spark, "csv"))
    return files.load_delimited(spark, path, ",").cells


@query(f"WITH {_E} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM E WHERE i BETWEEN 128 AND 383 AND j BETWEEN 16 AND 47")
def mat_tile_read(spark, sf_dir):
    from gridloom.operators.cells import tile

    return rounded(tile(embeddings(spark, sf_dir).cells, 128, 16, 256, 32), "v")


@query(f"WITH {_E} SELECT COUNT(*) AS n_cells, (SELECT (MAX(i) + 1) * (MAX(j) + 1) FROM E) AS n_expected, COUNT(*) - COUNT(DISTINCT (i, j)) AS n_repeated, CAST(0 AS BIGINT) AS n_outside, COUNT(*) - COUNT(v) AS n_nulls, COUNT(*) FILTER (WHERE isnan(v)) AS n_nans, COUNT(*) FILTER (WHERE isinf(v)) AS n_infinite FROM E")
def mat_validate(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return files.problems(e.cells, *e.shape)


@query(f"WITH {_E} SELECT COUNT(*) AS n_cells, (SELECT (MAX(i) + 1) * (MAX(j) + 1) FROM E) AS n_expected, COUNT(*) - COUNT(DISTINCT (i, j)) AS n_repeated, CAST(0 AS BIGINT) AS n_outside, COUNT(*) - COUNT(v) AS n_nulls, COUNT(*) FILTER (WHERE isnan(v)) AS n_nans, COUNT(*) FILTER (WHERE isinf(v)) AS n_infinite FROM E")
def source_checked(spark, sf_dir):
    """E to .npy and to the native form; the counts that the writing tasks found."""
    files.save_file(path := _mounted(spark, "checked.npy"), embeddings(spark, sf_dir))
    target, _ = files.convert(spark, path, shared_path(spark, "checked"), dtype="float64", check=True)
    found = files.described(spark, target)["found"]
    return spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in found.items()))


@query(f"""WITH {_E}, s AS (SELECT MAX(i) + 1 AS n, MAX(j) + 1 AS m FROM E), t AS (SELECT k, CAST(k * (n - LEAST(n, 16)) // 8 AS BIGINT) AS row, CAST((8 - k) * (m - LEAST(m, 16)) // 8 AS BIGINT) AS col, CAST(LEAST(n, 16) AS BIGINT) AS h, CAST(LEAST(m, 16) AS BIGINT) AS w FROM s CROSS JOIN (SELECT unnest(range(0, 9)) AS k))
    SELECT row, col, COUNT(*) AS n_cells, MAX(h * w) AS n_expected, COUNT(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v)) AS n_bad FROM t JOIN E ON i >= row AND i < row + h AND j >= col AND j < col + w GROUP BY row, col""")
def source_tile_check(spark, sf_dir):
    """E in the native form, and the counts of nine unaligned tiles on its other diagonal."""
    e = embeddings(spark, sf_dir)
    files.save(path := shared_path(spark, "tiles"), e)
    (n, m), h, w = e.shape, min(e.shape[0], 16), min(e.shape[1], 16)
    return files.tile_problems(files.load(spark, path), [(k * (n - h) // 8, (8 - k) * (m - w) // 8, h, w) for k in range(9)])


@query(f"WITH {_E} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM E")
def mat_block_roundtrip(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(blocks.to_cells(blocks.to_blocks(e.cells, *e.shape, 48), block=48), "v")


@query(f"WITH {_E}, {_G} SELECT i, j, ROUND(v, 6) + 0.0 AS v FROM G")
def mat_block_matmul(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    b = blocks.to_blocks(e.cells, *e.shape)
    down, inner = -(-e.shape[1] // blocks.BLOCK), -(-e.shape[0] // blocks.BLOCK)
    return rounded(blocks.to_cells(blocks.matmul(blocks.transpose(b), b, down, down, inner)), "v")


@query("""WITH W AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(p - 1 AS BIGINT) AS j, CAST(FLOOR(CAST(v AS DOUBLE) * 1048576) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))
    SELECT a.j AS i, b.j AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM W a JOIN W b ON a.i = b.i GROUP BY 1, 2""")
def mat_block_integers(spark, sf_dir):
    """E in units of 2 ** -20, as integers: their exact products by blocks."""
    e = embeddings(spark, sf_dir)
    cells = e.cells.withColumn("v", F.floor(F.col("v").cast("double") * 1048576).cast("long"))
    rows, cols = e.shape
    up = lambda n: -(-n // 32)
    right = blocks.to_blocks(cells, rows, cols, 32, "bigint")
    left = blocks.to_blocks(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), cols, rows, 32, "bigint")
    return blocks.to_cells(blocks.matmul(left, right, up(cols), up(cols), up(rows)), "bigint", 32)


@query(f"WITH {_E} SELECT j AS i, i AS j, ROUND((v + v) * 2, 6) + 0.0 AS v FROM E")
def mat_block_algebra(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    b = blocks.to_blocks(e.cells, *e.shape, 48)
    return rounded(blocks.to_cells(blocks.transpose(blocks.scale(blocks.add(b, b), 2.0)), block=48), "v")


# ---- What a computation touches and costs


def _shape_of_e(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return embeddings(spark, sf_dir).shape


_AXES = f"n AS (SELECT MAX(vec_id) + 1 AS rows, MAX(len(embedding)) AS cols FROM embeddings), R AS (SELECT unnest(range(0, CAST((rows + {TILE - 1}) // {TILE} AS BIGINT))) AS x FROM n), C AS (SELECT unnest(range(0, CAST((cols + {TILE - 1}) // {TILE} AS BIGINT))) AS y FROM n)"


@query(f"WITH {_AXES} SELECT ROW_NUMBER() OVER (ORDER BY x, y, m) - 1 AS pos, m AS matrix, x * {TILE} AS r, y * {TILE} AS c FROM R CROSS JOIN C CROSS JOIN (VALUES ('A'), ('B')) s(m)")
def trace_add(spark, sf_dir):
    return cost.elementwise_accesses(spark, *_shape_of_e(spark, sf_dir), ["A", "B"], TILE)


@query(f"WITH {_AXES} SELECT ROW_NUMBER() OVER (ORDER BY x, y) - 1 AS pos, 'A' AS matrix, x * {TILE} AS r, y * {TILE} AS c FROM R CROSS JOIN C")
def trace_scale(spark, sf_dir):
    return cost.elementwise_accesses(spark, *_shape_of_e(spark, sf_dir), ["A"], TILE)


@query(f"""WITH {_AXES} SELECT ROW_NUMBER() OVER (ORDER BY a.y, b.y, x, m) - 1 AS pos, m AS matrix, CASE WHEN m = 'A' THEN a.y ELSE x END * {TILE} AS r, CASE WHEN m = 'A' THEN x ELSE b.y END * {TILE} AS c
    FROM C a CROSS JOIN C b CROSS JOIN R CROSS JOIN (VALUES ('A'), ('B')) s(m)""")
def trace_matmul(spark, sf_dir):
    rows, cols = _shape_of_e(spark, sf_dir)
    return cost.product_accesses(spark, cols, rows, cols, tile=TILE)


@query("""WITH n AS (SELECT MAX(vec_id) + 1 AS rows, MAX(len(embedding)) AS cols FROM embeddings), t AS (SELECT rows, cols, ((rows + 1023) // 1024) * ((cols + 1023) // 1024) AS tiles FROM n)
    SELECT 'add-scale' AS plan, CAST(2 * tiles AS BIGINT) AS io_ops, CAST(2 * tiles AS BIGINT) AS compute_ops, CAST(2 * rows * cols * 4 AS BIGINT) AS memory_bytes, CAST(0.3 AS DOUBLE) AS cache_benefit, CAST(202 * tiles AS BIGINT) AS total FROM t
    UNION ALL SELECT 'scale', CAST(2 * tiles AS BIGINT), CAST(tiles AS BIGINT), CAST(rows * cols * 8 AS BIGINT), CAST(0 AS DOUBLE), CAST(201 * tiles AS BIGINT) FROM t""")
def plan_cost(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    rows = [(name, *(int(x[k]) for k in ("io_ops", "compute_ops", "memory_bytes")), float(x["cache_benefit"]), int(x["total"])) for name, x in (("add-scale", ((e + e) * 2.5).report()["cost"]), ("scale", (e * 2.5).report()["cost"]))]
    return spark.createDataFrame(rows, "plan string, io_ops long, compute_ops long, memory_bytes long, cache_benefit double, total long")


# ---- The cache's event log


@query(f"WITH {_LOG} SELECT seq, ts, event_type, matrix, r, c, tile, cache_len FROM log")
def cache_event_log(spark, sf_dir):
    return log_of(spark, sf_dir)


@query(f"WITH {_LOG} SELECT event_type, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent FROM log GROUP BY event_type")
def cache_event_counts(spark, sf_dir):
    return rounded(stats.event_counts(log_of(spark, sf_dir)), "percent")


@query(f"WITH {_LOG} SELECT seq, event_type, tile FROM log WHERE seq % GREATEST(1, (SELECT COUNT(*) FROM log) // 1000) = 0")
def cache_sampled(spark, sf_dir):
    return stats.sampled(log_of(spark, sf_dir), 1000).select("seq", "event_type", "tile")


@query(f"WITH {_LOG} SELECT seq, event_type, DENSE_RANK() OVER (ORDER BY tile) AS tile_rank FROM log")
def cache_timeline(spark, sf_dir):
    return stats.timeline(log_of(spark, sf_dir))


@query(f"WITH {_LOG}, {_ACCESS} SELECT r, c, COUNT(*) FILTER (WHERE matrix = 'A') AS a_count, COUNT(*) FILTER (WHERE matrix = 'B') AS b_count, COUNT(*) FILTER (WHERE matrix = 'A') - COUNT(*) FILTER (WHERE matrix = 'B') AS difference FROM acc GROUP BY r, c")
def cache_heatmap(spark, sf_dir):
    return stats.heat_map(log_of(spark, sf_dir))


@query(f"""WITH {_LOG}, {_ACCESS} SELECT CAST(k AS INTEGER) AS level, r // CAST(pow(2, k) AS BIGINT) AS r, c // CAST(pow(2, k) AS BIGINT) AS c, COUNT(*) FILTER (WHERE matrix = 'A') AS a_count, COUNT(*) FILTER (WHERE matrix = 'B') AS b_count
    FROM acc CROSS JOIN (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2, 3""")
def cache_heat_pyramid(spark, sf_dir):
    return stats.heat_pyramid(log_of(spark, sf_dir))


@query("SELECT l_returnflag, ROUND(QUANTILE_CONT(l_extendedprice, 0.37), 4) AS q37 FROM lineitem GROUP BY 1")
def selected_quantiles(spark, sf_dir):
    """A quantile of each kind of line by selection, without a sort."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    kinds = [r[0] for r in lines.select("l_returnflag").distinct().collect()]
    found = [stats.quantile(lines.where(F.col("l_returnflag").eqNullSafe(k)), "l_extendedprice", 0.37).select(F.lit(k).alias("l_returnflag"), F.col("quantile").alias("q37")) for k in kinds]
    return rounded(functools.reduce(DataFrame.union, found), "q37", digits=4)


@query(f"""WITH {_LOG}, w AS (SELECT GREATEST(100, COUNT(*) // 50) AS size FROM log) SELECT seq // size AS "window", COUNT(*) AS n, ROUND(AVG(CASE WHEN event_type = 'HIT' THEN 1.0 ELSE 0.0 END), 9) AS hit_rate,
    ROUND(AVG(CASE WHEN event_type = 'EVICT' THEN 1.0 ELSE 0.0 END), 9) AS evict_rate, ROUND(AVG(cache_len) / {CAPACITY}, 9) AS fill FROM log CROSS JOIN w GROUP BY 1""")
def cache_windowed_rates(spark, sf_dir):
    return rounded(stats.windowed_rates(log_of(spark, sf_dir), CAPACITY), "hit_rate", "evict_rate", "fill", digits=9)


@query(f"WITH {_LOG}, {_ACCESS}, {_REUSE} SELECT seq, tile, distance FROM reuse")
def cache_reuse_distance(spark, sf_dir):
    return stats.reuse_distances(log_of(spark, sf_dir))


@query(f"""WITH {_LOG}, {_ACCESS}, {_REUSE}, e AS (SELECT MIN(LOG10(distance)) AS lo, MAX(LOG10(distance)) AS hi FROM reuse)
    SELECT CAST(CASE WHEN hi > lo THEN LEAST(FLOOR((LOG10(distance) - lo) / (hi - lo) * 30), 29) ELSE 0 END + 1 AS BIGINT) AS bin, COUNT(*) AS n FROM reuse CROSS JOIN e GROUP BY 1""")
def cache_distance_histogram(spark, sf_dir):
    return stats.distance_histogram(stats.reuse_distances(log_of(spark, sf_dir)))


@query(f"WITH {_LOG}, {_ACCESS}, {_REUSE} SELECT s AS cache_size, ROUND(AVG(CASE WHEN distance > s THEN 1.0 ELSE 0.0 END), 9) AS miss_rate FROM reuse CROSS JOIN (SELECT unnest(range(16, 513, 16)) AS s) GROUP BY s")
def cache_miss_curve(spark, sf_dir):
    return rounded(stats.miss_curve(stats.reuse_distances(log_of(spark, sf_dir))), "miss_rate", digits=9)


_DEPTHS = """ranked AS (SELECT seq, tile, ROW_NUMBER() OVER (ORDER BY seq) - 1 AS t FROM acc), told AS (SELECT *, COALESCE(LAG(t) OVER (PARTITION BY tile ORDER BY t), -1) AS before FROM ranked),
    depths AS (SELECT a.seq, a.tile, COUNT(s.t) AS depth FROM told a LEFT JOIN told s ON s.t > a.before AND s.t < a.t AND s.before < a.before WHERE a.before >= 0 GROUP BY 1, 2)"""


@query(f"WITH {_LOG}, {_ACCESS}, {_DEPTHS} SELECT seq, tile, depth FROM depths")
def cache_stack_distance(spark, sf_dir):
    return stack_distance.stack_distances(log_of(spark, sf_dir))


@query(f"WITH {_LOG}, {_ACCESS}, {_DEPTHS} SELECT s AS cache_size, ROUND(AVG(CASE WHEN depth >= s THEN 1.0 ELSE 0.0 END), 9) AS miss_rate FROM depths CROSS JOIN (SELECT unnest(range(16, 513, 16)) AS s) GROUP BY s")
def cache_exact_miss_curve(spark, sf_dir):
    return rounded(stack_distance.exact_miss_curve(stack_distance.stack_distances(log_of(spark, sf_dir))), "miss_rate", digits=9)


@query(f"""WITH {_LOG}, {_ACCESS}, {_REUSE} SELECT scenario, CAST(s AS BIGINT) AS cache_size, ROUND(AVG(CASE WHEN distance > s THEN 1.0 ELSE 0.0 END), 9) AS miss_rate
    FROM reuse CROSS JOIN (VALUES {", ".join(f"('{name}', {tiles})" for name, (_, tiles) in stats.SCENARIOS.items())}) x(scenario, s) GROUP BY 1, 2""")
def cache_scenarios(spark, sf_dir):
    return rounded(stats.scenario_rates(stats.reuse_distances(log_of(spark, sf_dir))), "miss_rate", digits=9)


@query(f"""WITH {_LOG}, g AS (SELECT seq - LAG(seq) OVER (ORDER BY seq) AS gap FROM log WHERE event_type = 'EVICT')
    SELECT COUNT(gap) AS n, ROUND(AVG(gap), 6) AS mean_gap, MIN(gap) AS min_gap, MAX(gap) AS max_gap FROM g""")
def cache_evict_gap(spark, sf_dir):
    return rounded(stats.gap_summary(log_of(spark, sf_dir)), "mean_gap")


@query(f"""WITH {_LOG}, {_ACCESS}, s AS (SELECT COUNT(*) AS n FROM log), told AS (SELECT seq - LAG(seq, 1, -1) OVER (PARTITION BY tile ORDER BY seq) - 1 AS gap FROM acc),
    g AS (SELECT gap FROM told UNION ALL SELECT n - 1 - MAX(seq) FROM acc CROSS JOIN s GROUP BY tile, n), w AS (SELECT CAST(1 AS BIGINT) << k AS length FROM (SELECT unnest(range(0, 41)) AS k)),
    f AS (SELECT length, SUM(GREATEST(gap - length + 1, 0)) AS absent FROM g CROSS JOIN w GROUP BY length)
    SELECT length, CAST(n - length + 1 AS BIGINT) AS windows, ROUND((SELECT COUNT(DISTINCT tile) FROM acc) - absent / CAST(n - length + 1 AS DOUBLE), 6) AS mean_tiles FROM f CROSS JOIN s WHERE length <= n""")
def cache_working_set_curve(spark, sf_dir):
    """The mean number of distinct tiles in windows of 1, 2, 4, ... events."""
    return rounded(working_set.mean_tiles(log_of(spark, sf_dir)), "mean_tiles")


@query(f"""WITH {_LOG}, {_ACCESS}, {_REUSE}, q AS (SELECT QUANTILE_CONT(distance, 0.8) AS p FROM reuse)
    SELECT ROUND(p, 6) AS p80, CAST({CAPACITY} AS BIGINT) AS capacity, CASE WHEN p > 1.5 * {CAPACITY} THEN 'grow' WHEN p < 0.7 * {CAPACITY} THEN 'shrink' ELSE 'keep' END AS advice FROM q""")
def cache_percentile(spark, sf_dir):
    return rounded(stats.recommended_size(stats.reuse_distances(log_of(spark, sf_dir)), CAPACITY), "p80")


@query(f"""WITH {_LOG}, w AS (SELECT COUNT(DISTINCT tile) AS n_tiles FROM log)
    SELECT n_tiles, ROUND(n_tiles / CAST({CAPACITY} AS DOUBLE), 9) AS ratio, CASE WHEN n_tiles > 4 * {CAPACITY} THEN 'far larger' WHEN n_tiles > 1.5 * {CAPACITY} THEN 'larger' ELSE 'fits' END AS verdict FROM w""")
def cache_working_set(spark, sf_dir):
    return rounded(stats.working_set(log_of(spark, sf_dir), CAPACITY), "ratio", digits=9)


@query(f"""WITH {_LOG}, r AS (SELECT AVG(CASE WHEN event_type = 'HIT' THEN 1.0 ELSE 0.0 END) AS hit, AVG(CASE WHEN event_type = 'EVICT' THEN 1.0 ELSE 0.0 END) AS ev, COUNT(DISTINCT tile) / CAST({CAPACITY} AS DOUBLE) AS ws FROM log)
    SELECT ROUND(hit, 9) AS hit_rate, ROUND(ev, 9) AS evict_rate, ROUND(ws, 9) AS working_set,
    COALESCE(NULLIF(CONCAT_WS('; ', CASE WHEN hit < 0.6 THEN 'low hit rate' END, CASE WHEN ev > 0.15 THEN 'many evictions' END, CASE WHEN ev < 0.01 THEN 'cache never fills' END, CASE WHEN ws > 3 THEN 'working set too large' END), ''), 'none') AS advice FROM r""")
def cache_advice(spark, sf_dir):
    return rounded(stats.advice(log_of(spark, sf_dir), CAPACITY), "hit_rate", "evict_rate", "working_set", digits=9)


@query("SELECT event_type AS name, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS least, ROUND(MAX(value), 6) AS most FROM events GROUP BY event_type")
def profile_summary(spark, sf_dir):
    entries = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("duration"))
    return rounded(rounded(stats.profile_summary(entries), "total", digits=4), "mean", "least", "most")
