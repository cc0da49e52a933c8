"""Tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = found or "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}-{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _offsets(counted: DataFrame, *part: str) -> DataFrame:
    """counted with offset: how many rows the parts before have. As many rows as there are partitions (or splits of files)."""
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")


def file_index(df: DataFrame, name: str) -> DataFrame:
    """df, rows of a scan of files (rows may be filtered), with a column of consecutive numbers from 0 in the order of the files' names and of the places in them.

    Spark may read a folder's files in any order and cut them into splits; a split is read in order by one task. Only the
    splits' counts meet in one place.
    """
    split = ["_file", "_start"]
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_mark", F.monotonically_increasing_id())
    counted = marked.groupBy(*split).agg(F.count(F.lit(1)).alias("count"), F.min("_mark").alias("_first"))
    return marked.join(_offsets(counted, *split), split).withColumn(name, F.col("offset") + F.col("_mark") - F.col("_first")).drop(*split, "_mark", "_first", "offset")


def ordered_index(df: DataFrame, name: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """df with consecutive numbers from 1 in the order of the given columns (which must tell rows apart).

    Rows are dealt by ranges of the order, numbered in their range, and shifted by the rows of the ranges before:
    no task sees all rows, as it would with a window over the whole table.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order)
    offsets = _offsets(dealt.groupBy("_part").count(), "_part")
    numbered = dealt.withColumn(name, F.row_number().over(inside).cast("long"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("offset")).drop("_part", "offset")
