"""Raw row-major matrix files as a Spark data source: ranges of rows in, ranges of rows out.

Reading: a file (or a folder of files in name order) is dealt into ranges of whole rows; filters on i choose the ranges
and the rows in them before a byte is read. Its size must be that of the shape, exactly.

Writing, in two phases: tasks write their ranges to places that no reader sees, and the driver's commit makes the whole
result visible by renaming, or its abort removes it. A range is written at its own place, so an attempt that runs again
or beside another writes the same bytes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.plans.dtypes import spark_type

NAME = "matrixfile"
RANGE_BYTES = 16 << 20  # of a range of rows that one task reads
BATCH_CELLS = 1 << 18  # cells of one Arrow batch


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """What opens a path, on the driver and in tasks: local paths and every kind of address that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's visible files in the order of their names."""
    fs, place = filesystem(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(place))
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]


@dataclass
class Rows(InputPartition):
    """Rows first to end of the matrix, from a byte of a file on; those that filters leave."""

    path: str
    at: int
    first: int
    end: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.cols, self.dtype, self.head = options["path"], int(options["rows"]), int(options["cols"]), np.dtype(options["dtype"]), int(options.get("head", 0))
        self.out = np.dtype(options["out"])
        self.low, self.high = 0, self.rows  # rows that filters leave

    def pushFilters(self, filters):
        """Bounds on i choose the rows to read; every other filter is Spark's."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("i",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                values = list(f.value) if isinstance(f, In) else [f.value]
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, min(values, default=self.rows) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, max(values, default=-1) + (not isinstance(f, LessThan)))
                if not isinstance(f, In):
                    continue
            yield f

    def partitions(self):
        width, out, first = self.cols * self.dtype.itemsize, [], 0
        if not width:
            return []
        step = max(1, RANGE_BYTES // width)
        for path, size in files_of(self.path):
            n = (size - self.head) // width
            low, high = max(self.low, first), min(self.high, first + n)
            out += [Rows(path, self.head + (lo - first) * width, lo, min(lo + step, high)) for lo in range(low, high, step)]
            first += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Rows):  # nothing is left to read
            return
        width, fs_path = self.cols * self.dtype.itemsize, filesystem(partition.path)
        step = max(1, BATCH_CELLS // self.cols)
        with fs_path[0].open_input_file(fs_path[1]) as f:
            for lo in range(partition.first, partition.end, step):
                n = min(step, partition.end - lo)
                raw = f.read_at(n * width, partition.at + (lo - partition.first) * width)
                values = np.frombuffer(raw, self.dtype).astype(self.out, copy=False)
                i = np.repeat(np.arange(lo, lo + n), self.cols)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.arange(self.cols), n)), pa.array(values)], ["i", "j", "v"])


@dataclass
class Written(WriterCommitMessage):
    ranges: list  # (first row, rows, part's name, the file that holds it)


class RawWriter(DataSourceArrowWriter):
    """Rows (i, row) of a task, in order of i. layout "file": one file of its full length from the start; "parts": a folder of files named by their first row."""

    def __init__(self, options: dict):
        self.path, self.rows, self.cols, self.dtype = options["path"], int(options["rows"]), int(options["cols"]), np.dtype(options["dtype"])
        self.layout, self.header = options.get("layout", "file"), bytes.fromhex(options.get("header", ""))
        self.hidden = f"{self.path.rstrip('/')}._{options['token']}"
        fs, place = filesystem(self.hidden)
        if self.layout == "parts":
            fs.create_dir(place)
        elif not isinstance(fs, pafs.LocalFileSystem):
            raise ValueError("one file is written by many tasks at once: only a mounted folder allows that; write parts instead")

    def prepare(self) -> None:
        if self.layout == "file":
            with open(filesystem(self.hidden)[1], "wb") as f:
                f.write(self.header)
                f.truncate(len(self.header) + self.rows * self.cols * self.dtype.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        ranges: list = []
        fs, place = filesystem(self.hidden)
        out, expected = None, None
        try:
            for batch in iterator:
                ids = batch.column(0).to_pylist()
                data = batch.column(1)
                lengths = np.diff(data.offsets.to_numpy())
                if ids and ((lengths != self.cols).any() or data.flatten().null_count):
                    raise ValueError(f"a row has other than {self.cols} values")
                flat = data.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(-1, self.cols)
                at = 0
                while at < len(ids):
                    end = at + 1
                    while end < len(ids) and ids[end] == ids[end - 1] + 1:
                        end += 1
                    if not 0 <= ids[at] <= ids[end - 1] < self.rows:
                        raise ValueError(f"row {ids[at]} is outside of the matrix")
                    raw = flat[at:end].tobytes()
                    if self.layout == "parts":
                        if ids[at] != expected:
                            if out is not None:
                                out.close()
                            part = f"part-{ids[at]:016d}.dat"
                            own = f"{place}/{part}.{uuid.uuid4().hex}"  # each attempt has a file of its own
                            out = fs.open_output_stream(own)
                            ranges.append([ids[at], 0, part, own])
                        out.write(raw)
                        ranges[-1][1] += end - at
                    else:
                        if out is None:
                            out = open(place, "r+b")
                        out.seek(len(self.header) + ids[at] * self.cols * self.dtype.itemsize)
                        out.write(raw)
                        ranges.append([ids[at], end - at, "", ""])
                    expected = ids[end - 1] + 1
                    at = end
        finally:
            if out is not None:
                out.close()
        return Written(ranges)

    def commit(self, messages) -> None:
        ranges = sorted(r for m in messages if m is not None for r in m.ranges)
        at = 0
        for first, n, *_ in ranges:
            if first != at:
                self.abort(messages)
                raise ValueError(f"the matrix lacks row {at} or repeats row {first}")
            at += n
        if at != self.rows:
            self.abort(messages)
            raise ValueError(f"the matrix has cells in {at} of {self.rows} rows")
        fs, place = filesystem(self.hidden)
        target = filesystem(self.path)[1]
        if self.layout == "parts":
            for _, _, part, written in ranges:
                fs.move(written, f"{place}/{part}")
            kept = {part for _, _, part, _ in ranges}
            for f in fs.get_file_info(pafs.FileSelector(place)):
                if f.base_name not in kept:  # of attempts that lost
                    fs.delete_file(f.path)
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            fs.delete_dir(target)
        fs.move(place, target)

    def abort(self, messages) -> None:
        fs, place = filesystem(self.hidden)
        kind = fs.get_file_info(place).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(place)
        elif kind == pafs.FileType.File:
            fs.delete_file(place)


class RawFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return json.loads(self.options["schema"])

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite) -> RawWriter:
        return RawWriter(self.options)


def read(spark: SparkSession, path: str, shape: tuple[int, int], dtype: str, out: str, head: int = 0) -> DataFrame:
    """Cells (i, j, v) of a raw file of dtype with `head` bytes in front, as values of type out. Files of another size than the shape's are refused."""
    rows, cols = shape
    width = cols * np.dtype(dtype).itemsize
    sizes = [size - head for _, size in files_of(path)]
    if sum(sizes) != rows * width or any(width and size % width for size in sizes):
        raise ValueError(f"{path} has {sum(sizes)} bytes of data, a matrix of {rows} x {cols} {dtype} has {rows * width}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFile)
    return spark.read.format(NAME).options(path=path, rows=rows, cols=cols, dtype=dtype, head=head, out=out, schema=json.dumps(f"i long, j long, v {spark_type(out)}")).load()


def write(rows: DataFrame, path: str, shape: tuple[int, int], dtype: str, layout: str = "file", header: bytes = b"") -> None:
    """(i, row) to a raw file or to a folder of parts, all or nothing."""
    spark = rows.sparkSession
    spark.dataSource.register(RawFile)
    options = {"path": path, "rows": shape[0], "cols": shape[1], "dtype": dtype, "layout": layout, "header": header.hex(), "token": uuid.uuid4().hex, "schema": json.dumps("i long, row array<double>")}
    writer = RawWriter(options)
    writer.prepare()
    dealt = rows.repartitionByRange("i").sortWithinPartitions("i")
    try:
        dealt.write.format(NAME).options(**{k: str(v) for k, v in options.items()}).mode("append").save()
    except Exception as e:
        writer.abort([])
        said = re.search(r"ValueError: (.*)", str(e))
        raise ValueError(said[1]) if said else e
