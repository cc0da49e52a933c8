"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import materialise, read_table

__all__ = ["BROADCAST_KEYS", "LOWER", "UPPER", "ascii_words", "crc_remainder", "materialise", "read_table", "semi_join", "threshold", "within"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. bytes.lower() and bytes.split() know ASCII only, which is what the contracts ask for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


#: Rows of a one-column key table up to which it may be broadcast: 2 million longs are about 64 MB in a hash relation.
BROADCAST_KEYS = 2_000_000


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df's rows whose key is in keys: broadcast after a check of the size, else by shuffle."""
    side = F.broadcast(keys) if within(keys, BROADCAST_KEYS) else keys
    return df.join(side, on, "left_semi")


def threshold(counts: DataFrame, most: int) -> int:
    """The least t for which at most `most` rows have n >= t, among counts to three digits. A histogram of a few thousand rows tells it, so that no task and no driver has to put the most frequent rows of all partitions in order."""
    unit = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.col("n").cast("double"))) - 2, F.lit(0)))
    histogram = counts.where("n >= 1").groupBy((F.floor(F.col("n") / unit) * unit).cast("long").alias("edge")).count().collect()
    total, found = 0, max((r["edge"] for r in histogram), default=0) + 1
    for row in sorted(histogram, key=lambda r: -r["edge"]):
        total += row["count"]
        if total > most:
            break
        found = row["edge"]
    return found
