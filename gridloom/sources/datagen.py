"""Synthetic expression matrices: log-normal values with patterns that a hundred genes share."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.api import Matrix, uniform
from gridloom.plans.logical import Leaf

PRESETS = {"small": (5_000, 5_000), "medium": (10_000, 10_000), "large": (20_000, 10_000), "xlarge": (30_000, 15_000)}
MU, SIGMA, MODULE, WEIGHT = 2.0, 1.5, 100, 0.3


def preset(name: str) -> tuple[int, int]:
    if name not in PRESETS:
        raise ValueError(f"unknown size {name}; use one of {', '.join(PRESETS)}")
    return PRESETS[name]


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal from two uniform numbers of the place, by Box and Muller."""
    a, b = uniform(seed, *parts), uniform(seed + 1, *parts)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def expression(i: Column, j: Column, seed: int) -> Column:
    """exp(normal) of the place plus a share of the normal of its module and column, at least 0."""
    own = F.exp(MU + SIGMA * normal(seed, i, j))
    return F.greatest(own + WEIGHT * normal(seed + 2, F.floor(i / MODULE), j), F.lit(0.0))


def gene_expression(spark: SparkSession, rows: int, cols: int, seed: int = 42) -> Matrix:
    places = spark.range(rows * cols).select(F.expr(f"id div {max(cols, 1)}").alias("i"), (F.col("id") % max(cols, 1)).alias("j"))
    return Matrix(Leaf(places.select("i", "j", expression(F.col("i"), F.col("j"), seed).cast("float").alias("v")), rows, cols, "float32"))
