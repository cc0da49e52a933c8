"""Best-fit packing of tokenised documents by minimum bin slack.

Texts are read once and give one row a piece: its document, place, length and checksum. Texts and ids never move.
How pieces are combined depends on their lengths only, so the plan is made from the count of each length, at most as
many rows as a sequence has tokens, however many documents there are: for each bin, starting with the longest piece
left, a subset-sum over the lengths that are left (a bitset of the sums that they reach) finds the fullest
combination, which is taken out as many times as the counts allow. The k-th piece of a length then follows from the
plan by arithmetic. Pieces are ranked without a group that grows with the data: tasks count in chunks, and the chunks
before give the offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise
from gridloom.llm.wordids import ids_of

SEQUENCE = 2048  # tokens in a sequence
CHUNK = 65_536  # pieces that a task ranks together
PIECES = "chunk long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
RANK_BITS = 48
SLICE = 512  # texts that are encoded together


def combinations(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many), ...]) until no piece is left: how many sequences are filled in which way.

    Each starts with the longest length left and takes the fullest subset of the others beside it, of longer pieces
    where several are equally full. The sums that the shorter lengths reach stay valid while a length has more pieces
    than fit into a sequence, so many bins share one table.
    """
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    if left and (min(left) < 1 or max(left) > size):
        raise ValueError(f"lengths must lie between 1 and {size}")
    order = list(left)
    mask = (1 << (size + 1)) - 1
    reach, valid = [1] * (len(order) + 1), 0  # reach[k]: sums of the k shortest lengths, as bits

    def reached(sums: int, length: int, copies: int) -> int:
        step = 1
        while copies > 0:
            n = min(step, copies)
            sums |= (sums << (n * length)) & mask
            copies -= n
            step *= 2
        return sums

    out = []
    for top in range(len(order) - 1, -1, -1):
        longest = order[top]
        while left[longest]:
            room, use = size - longest, {longest: 1}
            if room:
                for k in range(valid, top):
                    reach[k + 1] = reached(reach[k], order[k], min(left[order[k]], size // order[k]))
                valid = max(valid, top)
                more = min(left[longest] - 1, room // longest)
                sums = reached(reach[top], longest, more) & ((1 << (room + 1)) - 1)
                target = sums.bit_length() - 1
                for k, most in [(top, more), *((k, None) for k in range(top - 1, -1, -1))]:
                    if not target:
                        break
                    n = order[k]
                    copies = min(left[n] if most is None else most, target // n)
                    while not reach[k] >> (target - copies * n) & 1:
                        copies -= 1
                    if copies:
                        use[n] = use.get(n, 0) + copies
                        target -= copies * n
            times = min(left[n] // c for n, c in use.items())
            for n, c in use.items():
                before, left[n] = left[n], left[n] - times * c
                if min(before, size // n) != min(left[n], size // n):
                    valid = min(valid, order.index(n))
            out.append((times, list(use.items())))
    return out


def intervals(counts: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """The plan by length and rank: pieces of key >> RANK_BITS tokens from rank key & mask on lie in sequences from base on, `use` in each, the first at `at`."""
    taken, rows, base = dict.fromkeys(counts, 0), [], 0
    for times, use in combinations(counts, size):
        at = 0
        for n, c in use:
            rows.append((n << RANK_BITS | taken[n], c, base, at))
            taken[n] += times * c
            at += n * c
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {name: np.ascontiguousarray(table[:, k]) for k, name in enumerate(("key", "use", "base", "at"))}


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> pieces; nth counts the earlier pieces of equal length in the chunk."""
    words, part = ids_of(path), TaskContext.get().partitionId()
    seen, chunk, inside = np.zeros(size + 1, np.int64), 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            some, rows = batch.slice(lo, SLICE), []
            texts = [t or "" for t in some.column(1).to_pylist()]
            for doc, raw in zip(some.column(0).to_pylist(), words.encode(texts)):
                ids = np.frombuffer(raw + b"\0\0", "<u2").astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    if inside == CHUNK:
                        seen[:], chunk, inside = 0, chunk + 1, 0
                    rows.append((part << 24 | chunk, int(seen[len(own)]), doc, piece, start, len(own), zlib.crc32(own.tobytes())))
                    seen[len(own)] += 1
                    inside += 1
            yield _table(rows, PIECES)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _place(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """(rank, piece's columns) -> the piece in its sequence."""
    p = plan.value
    for batch in batches:
        rank, length = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("rank", "length"))
        at = np.searchsorted(p["key"], length << RANK_BITS | rank, "right") - 1
        nth = rank - (p["key"][at] & ((1 << RANK_BITS) - 1))
        sequence, offset = p["base"][at] + nth // p["use"][at], p["at"][at] + nth % p["use"][at] * length
        own = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [f.split()[0] for f in PLACED.split(", ")])


def pack_best_fit(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence.

    A document longer than a sequence is cut into full ones and a rest; no other is cut. A null or empty text is the one
    token 0; repeated rows are packed as rows of their own, ties go by the place in the table; an empty table gives no
    rows; only doc_id and text are read.
    """
    spark = docs.sparkSession
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(lambda b: _cut(b, tokenizer, size), PIECES), "pieces")
    counted = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(intervals(counts, size))
    ranked = pieces.join(offsets, ["length", "chunk"]).select((F.col("nth") + F.col("before")).alias("rank"), "doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.mapInArrow(lambda b: _place(b, plan), PLACED)
