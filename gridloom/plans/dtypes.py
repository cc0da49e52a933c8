"""Element types: NumPy names, Spark types and how they combine."""

from __future__ import annotations

import numpy as np

SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean"}


def dtype_name(dtype) -> str:
    """The NumPy name of an element type. Complex, unsigned, object and date types are refused."""
    name = np.dtype(dtype).name
    if name not in SPARK:
        raise TypeError(f"matrices of {name} are not supported; use one of {', '.join(SPARK)}")
    return name


def spark_type(dtype) -> str:
    return SPARK[dtype_name(dtype)]


def of_spark(name: str) -> str:
    return {v: k for k, v in SPARK.items()}[name]


def promote(a: str, b: str) -> str:
    return dtype_name(np.promote_types(a, b))


def product(a: str, b: str) -> str:
    """Of sums of products: integers widen to int64, so that only overflow beyond that raises."""
    both = promote(a, b)
    return "int64" if np.issubdtype(np.dtype(both), np.integer) or both == "bool" else both


def scaled(dtype: str, scalar: float) -> str:
    """A Python scalar doesn't widen floats; a fraction turns integers into float64."""
    whole = isinstance(scalar, (bool, int))
    if np.issubdtype(np.dtype(dtype), np.floating):
        return dtype
    return product(dtype, dtype) if whole else "float64"
