"""Command line: python -m gridloom.cli convert | generate | validate."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from gridloom.sources import datagen, files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom")
    kinds = out.add_subparsers(dest="command", required=True)
    convert = kinds.add_parser("convert", help="a matrix file to the native form")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--format", choices=sorted(set(files.FORMATS.values())), help="by the ending if not given")
    convert.add_argument("--shape", type=int, nargs=2, metavar=("ROWS", "COLS"), help="of a raw binary file")
    convert.add_argument("--dtype", default="float32")
    convert.add_argument("--dataset", help="of an HDF5 file; its first if not given")
    convert.add_argument("--validate", action="store_true", help="check the result: complete, unique, finite")
    generate = kinds.add_parser("generate", help="synthetic expression data in the native form")
    generate.add_argument("target")
    generate.add_argument("--size", default="small", choices=sorted(datagen.PRESETS))
    generate.add_argument("--shape", type=int, nargs=2, metavar=("ROWS", "COLS"), help="instead of a size")
    generate.add_argument("--seed", type=int, default=42)
    validate = kinds.add_parser("validate", help="check a matrix in the native form")
    validate.add_argument("source")
    validate.add_argument("--tiles", type=int, help="check so many tiles instead of all cells")
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if a check failed."""
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    checked = None
    if args.command == "convert":
        try:
            target, shape = files.convert(spark, args.source, args.target, args.format, tuple(args.shape) if args.shape else None, args.dtype, args.dataset, args.validate)
        except files.InvalidMatrix as e:
            print(e)
            return 1
        print(f"{target}: {shape[0]} x {shape[1]}")
        if args.validate:
            print("valid")
    elif args.command == "generate":
        rows, cols = args.shape or datagen.preset(args.size)
        files.save(args.target, datagen.gene_expression(spark, rows, cols, args.seed))
        print(f"{args.target}: {rows} x {cols}")
    else:
        checked = args.source
    if checked is None:
        return 0
    matrix = files.load(spark, checked)
    good = files.valid(matrix) if args.tiles is None else files.sampled_valid(matrix, args.tiles)
    print("valid" if good else "not valid")
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
