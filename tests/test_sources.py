"""Files: native, raw, .npy, delimited; conversion and checks; generated data."""

import numpy as np
import pytest

from gridloom.cli import main
from gridloom import api
from gridloom.plans.logical import Leaf
from gridloom.sources import datagen, files
from gridloom.sources.shared import file_index, ordered_index

X = np.random.default_rng(1).random((23, 7)).astype("float32")


def test_native_round_trip(spark, folder):
    files.save(f"{folder}/m", api.array(spark, X))
    back = api.Matrix(files.load(spark, f"{folder}/m").node)
    assert back.shape == X.shape and (back.to_numpy() == X).all() and files.valid(back)
    with pytest.raises(ValueError):
        files.load(spark, f"{folder}/none")


@pytest.mark.parametrize("dtype", ["float32", "float64", "int32"])
def test_raw(spark, folder, dtype):
    x = (X * 100).astype(dtype)
    x.tofile(f"{folder}/a.dat")
    assert (files.load(spark, f"{folder}/a.dat", x.shape, dtype).to_numpy() == x).all()
    files.save_raw(f"{folder}/out", api.array(spark, x, dtype))
    import os

    data = b"".join(open(f"{folder}/out/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/out")) if n.endswith(".dat"))
    assert (np.frombuffer(data, dtype).reshape(x.shape) == x).all()


def test_conversion(spark, folder):
    np.save(f"{folder}/a.npy", X)
    np.savetxt(f"{folder}/a.csv", X, delimiter=",")
    np.savetxt(f"{folder}/a.txt", X, delimiter="\t")
    X.tofile(f"{folder}/a.bin")
    for name, extra in (("a.npy", {}), ("a.csv", {}), ("a.txt", {}), ("a.bin", {"shape": X.shape})):
        path, shape = files.convert(spark, f"{folder}/{name}", f"{folder}/{name}-out", **extra)
        assert shape == X.shape and np.allclose(files.load(spark, path).to_numpy(), X)
    with pytest.raises(ValueError):
        files.convert(spark, f"{folder}/a.bin", f"{folder}/x")
    with pytest.raises(ValueError):
        files.convert(spark, f"{folder}/a.bin", f"{folder}/x", format="odd")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            files.convert(spark, f"{folder}/a.h5", f"{folder}/x")
    assert [files.detect_format(n) for n in ("A.NPY", "b.hdf5", "c.tsv", "d.odd")] == ["npy", "hdf5", "tsv", "binary"]


def test_problems(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, float("nan")), (5, 0, float("inf")), (1, 0, None)], "i long, j long, v double")
    row = files.problems(cells, 2, 2).first()
    assert row.asDict() == {"n_cells": 5, "n_expected": 4, "n_repeated": 1, "n_outside": 1, "n_nulls": 1, "n_nans": 1, "n_infinite": 1}
    assert not files.valid(api.Matrix(Leaf(cells, 2, 2, "float64")))
    empty = files.problems(cells.limit(0), 0, 0).first()
    assert empty.n_cells == 0


def test_expression_data(spark):
    a = datagen.gene_expression(spark, 120, 50, seed=42).to_numpy()
    assert (a == datagen.gene_expression(spark, 120, 50, seed=42).to_numpy()).all() and a.min() >= 0 and (a != datagen.gene_expression(spark, 120, 50, seed=123).to_numpy()).any()
    assert abs(np.log(np.maximum(a, 1e-3)).mean() - 2) < 0.2
    assert datagen.preset("small") == (5000, 5000)
    with pytest.raises(ValueError):
        datagen.preset("tiny")


def test_indexes(spark, folder):
    spark.range(100, numPartitions=7).selectExpr("cast(id as string) as value").write.text(f"{folder}/t")
    got = file_index(spark.read.text(f"{folder}/t"), "n").collect()
    assert sorted(r.n for r in got) == list(range(100))
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "a long, b long")
    numbered = ordered_index(rows, "n", ["a", "b"]).collect()
    assert [r.n for r in sorted(numbered, key=lambda r: (r.a, r.b))] == list(range(1, 201))


def test_folder_of_files_in_the_order_of_their_names(spark, folder):
    """Spark reads the largest file first; rows are numbered by name, whatever the files' sizes and splits, and empty lines don't count."""
    import os

    os.makedirs(f"{folder}/t")
    rows = [[float(i), i + 0.5] for i in range(600)]
    for name, part in (("a.csv", rows[:1]), ("b.csv", rows[1:500]), ("c.csv", []), ("d.csv", rows[500:])):
        with open(f"{folder}/t/{name}", "w") as f:
            f.write("\n".join(f"{a},{b}\n" for a, b in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = files.load_delimited(spark, f"{folder}/t", ",").to_numpy()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.tolist() == rows


@pytest.mark.parametrize("name", ["m.dat", "m.npy"])
def test_one_file(spark, folder, name):
    m = api.array(spark, X)
    files.save_file(f"{folder}/{name}", m)
    back = files.load(spark, f"{folder}/{name}", X.shape) if name.endswith("dat") else files.load_npy(spark, f"{folder}/{name}")
    assert (back.to_numpy() == X).all()
    with pytest.raises(ValueError):
        files.save_file(f"{folder}/{name}", api.Matrix(Leaf(m.cells.where("i < 5"), *X.shape, "float32")))


def test_command_line(spark, folder, capsys):
    from gridloom import cli

    np.save(f"{folder}/a.npy", X)
    assert cli.main(["convert", f"{folder}/a.npy", f"{folder}/out", "--validate"], spark) == 0
    assert (files.load(spark, f"{folder}/out").to_numpy() == X).all()
    assert cli.main(["generate", f"{folder}/g", "--shape", "30", "20"], spark) == 0 and files.load(spark, f"{folder}/g").shape == (30, 20)
    files.save(f"{folder}/bad", api.array(spark, [[1.0, float("nan")]]))
    assert cli.main(["validate", f"{folder}/bad"], spark) == 1 and "not valid" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["generate", f"{folder}/x", "--size", "tiny"], spark)


def test_shared_folder_of_a_cluster():
    """Where spark.checkpoint.dir is unset, only a local session may make up a folder."""
    from types import SimpleNamespace

    from gridloom.sources.shared import shared_folder

    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None)))


def test_raw_files_of_another_size_are_refused(spark, folder):
    X[:4].tofile(f"{folder}/a.dat")
    for shape in ((8, 7), (2, 7), (4, 6), (4, 8), (0, 7)):
        with pytest.raises(ValueError):
            files.load(spark, f"{folder}/a.dat", shape)
        with pytest.raises(ValueError):
            files.convert(spark, f"{folder}/a.dat", f"{folder}/x", shape=shape)
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{folder}/none.dat", (4, 7))
    assert files.load(spark, f"{folder}/a.dat", (7, 4)).shape == (7, 4)


def test_raw_reader_reads_only_the_rows_asked_for(spark, folder, monkeypatch):
    """Filters on i choose byte ranges: counted in the partitions of the reader, and in the rows that Spark gets from it."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    from gridloom.sources import rawfile

    x = np.arange(1000 * 8, dtype="float32").reshape(1000, 8)
    x.tofile(f"{folder}/a.dat")
    options = {"path": f"{folder}/a.dat", "rows": "1000", "cols": "8", "dtype": "float32", "out": "float32"}
    monkeypatch.setattr(rawfile, "RANGE_BYTES", 32 * 100)

    def ranges(*filters):
        reader = rawfile.RawReader(options)
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        return len(left), len(parts), sum(p.end - p.first for p in parts), [b for p in parts for b in reader.read(p)]

    assert ranges()[:3] == (0, 10, 1000)
    left, n, rows, batches = ranges(GreaterThanOrEqual(("i",), 250), LessThan(("i",), 270))
    assert (left, n, rows) == (0, 1, 20) and batches[0].column(2).to_numpy()[0] == 2000
    assert ranges(EqualTo(("i",), 7))[:3] == (0, 1, 1) and ranges(In(("i",), (3, 9)))[:3] == (1, 1, 7) and ranges(EqualTo(("i",), 5000))[:3] == (0, 0, 0)
    assert ranges(EqualTo(("j",), 5))[:3] == (1, 10, 1000)
    m = files.load(spark, f"{folder}/a.dat", (1000, 8))
    got = m.cells.where("i >= 250 AND i < 270 AND j = 3")
    assert sorted((r.i, r.v) for r in got.collect()) == [(i, i * 8 + 3.0) for i in range(250, 270)]
    assert "GreaterThanOrEqual" in got._jdf.queryExecution().executedPlan().toString() or "i#" in got._jdf.queryExecution().executedPlan().toString()
    assert m.cells.where("i = 5000").count() == 0 and (m.tile(990, 2, 50, 3).to_numpy() == x[990:, 2:5]).all()


def test_writing_is_all_or_nothing(spark, folder):
    """A task that fails, a row that is missing or repeated: nothing new is seen, and what was there stays."""
    import os

    from pyspark.sql import functions as F

    m = api.array(spark, X)
    for save, name in ((files.save_file, "m.dat"), (files.save_raw, "parts")):
        save(f"{folder}/{name}", m)
        before = {n: open(f"{folder}/{name}/{n}", "rb").read() for n in os.listdir(f"{folder}/{name}")} if name == "parts" else open(f"{folder}/{name}", "rb").read()
        bad = F.when(F.col("i") == 20, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("float").alias("v")
        for cells in (m.cells.select("i", "j", bad), m.cells.where("i <> 11"), m.cells.where("i <> 11 OR j < 3"), m.cells.union(m.cells.where("i = 3").withColumn("i", F.lit(30).cast("long")))):
            with pytest.raises(Exception):
                save(f"{folder}/{name}", api.Matrix(Leaf(cells, *X.shape, "float32")))
        after = {n: open(f"{folder}/{name}/{n}", "rb").read() for n in os.listdir(f"{folder}/{name}")} if name == "parts" else open(f"{folder}/{name}", "rb").read()
        assert before == after
        save(f"{folder}/{name}", m)
        assert (files.load(spark, f"{folder}/{name}", X.shape).to_numpy() == X).all()
    assert sorted(os.listdir(folder)) == ["m.dat", "parts"]


def test_attempts_write_equal_bytes(spark, folder):
    """Two attempts of one task, one after the other or cut short: the committed file has each row once."""
    import pyarrow as pa

    from gridloom.sources.rawfile import RawWriter

    for layout in ("file", "parts"):
        options = {"path": f"{folder}/{layout}", "rows": "4", "cols": "2", "dtype": "float32", "layout": layout, "token": "t"}
        writer = RawWriter(options)
        writer.prepare()
        batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array([[float(r), r + 0.5] for r in rows])], ["i", "row"])

        def broken():
            yield batch(0, 1)
            raise RuntimeError

        with pytest.raises(RuntimeError):
            writer.write(broken())
        first, again, second = writer.write(iter([batch(0, 1)])), writer.write(iter([batch(0), batch(1)])), writer.write(iter([batch(2, 3)]))
        assert [r[:3] for r in first.ranges][0][0] == 0
        writer.commit([again, second, None])
        got = files.load(spark, f"{folder}/{layout}", (4, 2)).to_numpy()
        assert got.tolist() == [[float(r), r + 0.5] for r in range(4)]


def test_npy_orders_and_types(spark, folder):
    for k, x in enumerate((np.asfortranarray(X), X.astype(">f8"), (X * 100).astype("uint8"), np.zeros((0, 3)), X[:1])):
        np.save(f"{folder}/{k}.npy", x)
        back = files.load_npy(spark, f"{folder}/{k}.npy", "float32")
        assert back.shape == x.shape and np.allclose(back.to_numpy(), x)
    np.save(f"{folder}/one.npy", np.zeros(3))
    with pytest.raises(ValueError):
        files.load_npy(spark, f"{folder}/one.npy")


def test_ragged_lines_are_refused(spark, folder):
    for name, text in (("short.csv", "1,2,3\n4,5\n"), ("long.csv", "1,2\n3,4,5\n"), ("word.csv", "1,x\n")):
        open(f"{folder}/{name}", "w").write(text)
        with pytest.raises(Exception):
            files.load_delimited(spark, f"{folder}/{name}", ",").to_numpy()
    open(f"{folder}/none.csv", "w").write("\n")
    assert files.load_delimited(spark, f"{folder}/none.csv", ",").shape == (0, 0)


def test_morton_order_skips_files(spark, folder):
    """Of 64 files, a slab of rows, one of columns and a tile touch about their share, by the files' statistics."""
    import glob

    import pyarrow.parquet as pq

    n, side = 256, 32
    m = api.random_rand(spark, (n, n), seed=4)
    files.save(f"{folder}/m", m, side=side, cells_per_file=side * side)
    assert (files.load(spark, f"{folder}/m").to_numpy() == m.to_numpy()).all()
    stats = []
    for path in glob.glob(f"{folder}/m/cells/*.parquet"):
        meta = pq.read_metadata(path)
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        stats.append([(min(g.column(c).statistics.min for g in groups), max(g.column(c).statistics.max for g in groups)) for c in (0, 1)])
    touched = lambda i, j: sum(a[0] < i[1] and a[1] >= i[0] and b[0] < j[1] and b[1] >= j[0] for a, b in stats)
    assert len(stats) >= 64
    everything, extra = (0, n), len(stats) / 64 + 1
    assert touched((32, 64), everything) <= 8 * extra and touched(everything, (96, 128)) <= 8 * extra and touched((64, 96), (128, 160)) <= 2 * extra


@pytest.mark.parametrize("places", [[(0, 0), (1, 1)], [(5, 3), (2**20, 2**15)]])
def test_morton(spark, places):
    from pyspark.sql import functions as F

    got = spark.createDataFrame(places, "i long, j long").select(files.morton(F.col("i"), F.col("j"), 1).alias("m")).collect()
    assert [r.m for r in got] == [sum((i >> k & 1) << (2 * k + 1) | (j >> k & 1) << (2 * k) for k in range(31)) for i, j in places]


def _counted(spark, m):
    """m with an accumulator of the cells that its source hands out."""
    handed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            handed.add(batch.num_rows)
            yield batch

    return api.Matrix(Leaf(m.cells.mapInArrow(count, m.cells.schema), *m.shape, m.node.dtype)), handed


def test_saving_finds_what_is_wrong_and_reads_once(spark, folder):
    m, handed = _counted(spark, api.random_rand(spark, (300, 70), seed=2))
    counts = files.save(f"{folder}/m", m, side=32)
    assert handed.value == 21_000 and files.clean(counts) and counts["n_cells"] == 21_000
    assert files.described(spark, f"{folder}/m")["found"] == counts
    assert (files.load(spark, f"{folder}/m").to_numpy() == m.to_numpy()).all()
    nan, inf = float("nan"), float("inf")
    bad = [(0, 0, 1.0), (0, 0, 1.0), (0, 0, 2.0), (0, 1, nan), (1, 0, inf), (1, 1, None), (2, 0, -inf), (-1, 0, 1.0)]
    cells = spark.createDataFrame(bad, "i long, j long, v double")
    for side in (1, 256):
        counts = files.save(f"{folder}/bad{side}", api.Matrix(Leaf(cells, 2, 2, "float64")), side=side)
        assert counts == files.problems(cells, 2, 2).first().asDict() and not files.clean(counts)
    empty = files.save(f"{folder}/none", api.Matrix(Leaf(cells.limit(0), 0, 0, "float64")))
    assert files.clean(empty) and set(empty.values()) == {0}


def test_conversion_checks_while_it_writes(spark, folder, capsys):
    x = X.copy()
    np.save(f"{folder}/good.npy", x)
    x[1, 1] = np.nan
    np.save(f"{folder}/bad.npy", x)
    assert files.convert(spark, f"{folder}/good.npy", f"{folder}/good", check=True)[1] == X.shape
    with pytest.raises(files.InvalidMatrix) as e:
        files.convert(spark, f"{folder}/bad.npy", f"{folder}/bad", check=True)
    assert e.value.counts["n_nans"] == 1 and files.described(spark, f"{folder}/bad")["found"]["n_nans"] == 1
    assert main(["convert", f"{folder}/bad.npy", f"{folder}/out", "--validate"], spark) == 1
    assert main(["convert", f"{folder}/good.npy", f"{folder}/out", "--validate"], spark) == 0 and main(["validate", f"{folder}/out", "--tiles", "3"], spark) == 0
    assert "n_nans 1" in capsys.readouterr().out


def test_sampled_check(spark, folder):
    n, side = 200, 16
    good = api.random_rand(spark, (n, n), seed=9)
    files.save(f"{folder}/m", good, side=side)
    loaded = files.load(spark, f"{folder}/m")
    tiles = files.sample_tiles(n, n, 6, side, seed=3)
    assert tiles == files.sample_tiles(n, n, 6, side, seed=3) != files.sample_tiles(n, n, 6, side, seed=4)
    assert all(0 <= i <= n - side and 0 <= j <= n - side for i, j, *_ in tiles)
    assert files.sampled_valid(loaded, 6, side, 3)
    plan = files.tile_problems(loaded, tiles)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    i, j, *_ = tiles[0]
    for wrong in (loaded.cells.where(f"NOT (i = {i} AND j = {j})"), loaded.cells.selectExpr("i", "j", f"IF(i = {i} AND j = {j}, float('NaN'), v) AS v")):
        assert not files.sampled_valid(api.Matrix(Leaf(wrong, n, n, "float64")), 6, side, 3)
    assert files.sampled_valid(api.zeros(spark, (3, 2)), 4) and files.sampled_valid(api.Matrix(Leaf(loaded.cells.limit(0), 0, 0, "float64")), 4)


STAND_IN = """
import numpy
class File(dict):
    def __init__(self, path, mode="r"):
        with open(path, "rb") as f:
            super().__init__(numpy.load(f))
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
"""


def test_hdf5_chunks(spark, folder, monkeypatch):
    """Ranges of rows, the named or the first dataset, types and wrong dimensions, through a stand-in that has the few calls the reader makes (File, keys, shape, slices); the package itself is not installed here."""
    import os
    import sys

    name = "h5py_stand_in"
    with open(f"{folder}/{name}.py", "w") as f:
        f.write(STAND_IN)
    spark.sparkContext.addPyFile(f"{folder}/{name}.py")
    monkeypatch.setitem(sys.modules, "h5py", __import__(name))
    rows = files.ROWS_AT_ONCE * 2 + 3
    big = np.arange(rows * 2, dtype="int32").reshape(rows, 2)
    with open(f"{folder}/a.h5", "wb") as f:
        np.savez(f, first=X, big=big, line=np.arange(3))
    assert (files.load_hdf5(spark, f"{folder}/a.h5").to_numpy() == X).all()
    found = files.load_hdf5(spark, f"{folder}/a.h5", "big", "int32")
    assert found.shape == big.shape and (found.to_numpy() == big).all()
    target, shape = files.convert(spark, f"{folder}/a.h5", f"{folder}/native", dataset="first", check=True)
    assert shape == X.shape and (files.load(spark, target).to_numpy() == X).all() and os.path.exists(target)
    with pytest.raises(ValueError):
        files.load_hdf5(spark, f"{folder}/a.h5", "line")


def test_constructor(spark, folder):
    assert (api.ndarray(spark, X).to_numpy() == X).all() and api.ndarray(spark, X.astype("int32"), dtype="int32").dtype == np.int32
    empty = api.ndarray(spark, shape=(3, 4))
    assert empty.shape == (3, 4) and not empty.to_numpy().any()
    X.tofile(f"{folder}/a.bin")
    assert (api.ndarray(spark, filepath=f"{folder}/a.bin", shape=X.shape).to_numpy() == X).all()
    for wrong in ({}, {"filepath": f"{folder}/a.bin", "shape": (X.shape[0] + 1, X.shape[1])}, {"data": X, "shape": (1, 2)}, {"data": [1, 2]}, {"shape": (-1, 2)}):
        with pytest.raises(ValueError):
            api.ndarray(spark, **wrong).to_numpy()
