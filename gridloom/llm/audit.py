"""How filters of a corpus interact: which rows each order of filters removes, and at which step.

Words are counted in a sparse document-term matrix. Each task turns its texts into a CSR shard with numbers of its
own; the shards' distinct words then get global numbers from one dictionary, and the shards are renumbered by it.
Row sums and counts of nonzero cells decide the filters on length and repetition. Only words of shards are shuffled,
once each, not occurrences; a word is as frequent there as there are shards.

Rows are then reduced to a set of failed filters. What the orders do follows from how many rows of each part have
which set: at most 32 counts a part, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

FILTERS = "ABCDE"
WORDS, SHARE, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"  # fewest words, least percent of distinct ones, most percent of capitals, characters that a text may not have
SHARD_BYTES = 8 << 20  # of text in a shard, about
BUCKETS = 1 << 16  # of the dictionary, so many tasks at most can number words
HOT = 1000  # a key with more than a HOT-th of all rows is hot: fewer than HOT keys are
_CAPITALS, _INNER = bytes(range(65, 91)), bytes(range(128, 192))  # A-Z; bytes that don't begin a code point
SHARDS = "doc_id array<long>, part array<string>, fails array<int>, digest array<binary>, indptr binary, indices binary, counts binary, words array<binary>"
CSR = "shard long, doc_id array<long>, part array<string>, fails array<int>, digest array<binary>, indptr binary, indices binary, counts binary"
ROWS = "doc_id long, part string, n_words long, n_distinct long, fails int, digest binary"


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """words, indptr, indices, counts: a CSR matrix whose column k is the k-th distinct word of these texts."""
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    indptr, indices, counts = [0], [], []
    for text in texts:
        words = text.split()
        columns, n = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
        indices.append(columns)
        counts.append(n.astype(np.int32))
        indptr.append(indptr[-1] + len(columns))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    return list(known), np.array(indptr, np.int64), joined(indices), joined(counts)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def _other_failures(text: bytes) -> int:
    """Bits of C and D."""
    capitals, characters = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _INNER))
    return (4 if 100 * capitals > CAPITALS * characters else 0) | (8 if len(text.translate(None, MARKS)) < len(text) else 0)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[bytes]]]:
    ids, parts, texts, size = [], [], [], 0
    for lo in range(0, batch.num_rows, 256):
        some = batch.slice(lo, 256)
        for i, part, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist()):
            if texts and size + len(text or b"") > SHARD_BYTES:
                yield ids, parts, texts
                ids, parts, texts, size = [], [], [], 0
            ids.append(i)
            parts.append(part)
            texts.append(text or b"")
            size += len(texts[-1])
    if texts:
        yield ids, parts, texts


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, parts, texts in _slices(batch):
            words, indptr, indices, counts = _numbered(texts)
            row = [ids, parts, [_other_failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts], indptr.tobytes(), _packed(np.diff(indices, prepend=np.int32(0))), _packed(counts), words]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in SHARDS.split(", ")])


def shards(docs: DataFrame) -> DataFrame:
    """Shards of (doc_id, part, text), written once: `shard` and SHARDS, columns of the matrix by the shard's own numbers. Indices (as differences) and counts are compressed."""
    built = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_shards, SHARDS)
    return materialise(built.withColumn("shard", F.monotonically_increasing_id()), "shards")


def dictionary(built: DataFrame) -> DataFrame:
    """word, term, shard, column: where each shard's words occur, and their number among the words of all shards.

    Words are dealt into buckets and numbered in their order inside the bucket, without holding its rows, so a task that
    runs again gives the same numbers. A word has a row a shard, not an occurrence.
    """
    places = built.select("shard", F.posexplode("words").alias("column", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    inside = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    return places.select("word", (F.shiftleft("bucket", 44) + inside).alias("term"), "shard", "column")


def _renumber(key: tuple[pa.Scalar, ...], shard: pa.Table, terms: pa.Table) -> pa.Table:
    """The shard with the dictionary's numbers as columns."""
    term = np.zeros(len(terms), np.int64)
    term[terms.column("column").to_numpy()] = terms.column("term").to_numpy()
    get = lambda name: shard.column(name)[0].as_py()
    cells = int(np.frombuffer(get("indptr"), np.int64)[-1])
    indices, counts = term[np.cumsum(_unpacked(get("indices"), cells))], _unpacked(get("counts"), cells)
    for name, values in (("indices", indices), ("counts", counts)):
        shard = shard.set_column(shard.schema.get_field_index(name), name, pa.array([values.tobytes()], pa.binary()))
    return shard


def _over_shards(docs: DataFrame, last, schema: str) -> DataFrame:
    """last() of each shard, renumbered by the dictionary."""
    built = shards(docs)
    terms = dictionary(built).select("shard", "column", "term")
    own = built.select(*(f.split()[0] for f in CSR.split(", ")))
    return own.groupBy("shard").cogroup(terms.groupBy("shard")).applyInArrow(lambda key, shard, term: last(_renumber(key, shard, term)), schema)


def document_term(docs: DataFrame) -> DataFrame:
    """The document-term matrix of (doc_id, source, text) as CSR shards over all documents' words: little-endian 64-bit indptr and indices, 32-bit counts."""
    return _over_shards(docs, lambda shard: shard, CSR)


def _sums(shard: pa.Table) -> pa.Table:
    get = lambda name: shard.column(name)[0]
    indptr, counts = np.frombuffer(get("indptr").as_py(), np.int64), np.frombuffer(get("counts").as_py(), np.int32)
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n_words, n_distinct = total[indptr[1:]] - total[indptr[:-1]], np.diff(indptr)
    fails = np.array(get("fails").as_py(), np.int32) | (n_words < WORDS) | (100 * n_distinct < SHARE * n_words).astype(np.int32) << 1
    columns = [get("doc_id").values, get("part").values, pa.array(n_words), pa.array(n_distinct), pa.array(fails.astype(np.int32)), get("digest").values]
    return pa.table(dict(zip((f.split()[0] for f in ROWS.split(", ")), columns)))


def row_sums(docs: DataFrame) -> DataFrame:
    """One row per document, from the document-term matrix: its words (row sum), distinct words (nonzero cells), failed filters as bits (A is 1, B 2, C 4, D 8) and the digest of its text."""
    return _over_shards(docs, _sums, ROWS)


def attached(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table (one row a key) or nulls.

    Fewer than HOT keys can hold more than a HOT-th of all rows: those get their columns by a broadcast of as many rows,
    the others by a shuffle in which no key is frequent. Null keys meet nothing.
    """
    n = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT > n).select(key)
    found = materialise(table.join(F.broadcast(hot), key, "left_semi"), "hot")
    keys = materialise(hot, "hot-keys")
    more = [c for c in table.columns if c != key]
    few = rows.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(found), key, "left")
    many = rows.where(F.col(key).isNotNull()).join(F.broadcast(keys), key, "left_anti").join(table, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in more))
    return few.select(*rows.columns, *more).unionByName(many.select(*rows.columns, *more)).unionByName(none)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), good, toxic of each row of docs."""
    rows = materialise(row_sums(docs).select("doc_id", "part", "fails", "digest"), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = attached(attached(rows, first, "digest"), marks, "doc_id")
    repeated = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    return both.select("part", (F.col("fails") + 16 * repeated).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _steps() -> Column:
    """Every order of the filters, step by step: the order, the step, the filter's bit and the bits of those before it."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            rows.append("|".join(map(str, ("".join(FILTERS[x] for x in order), k + 1, 1 << f, sum(1 << x for x in order[:k])))))
    return F.split(F.lit(",".join(rows)), ",")


def interactions(failed: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of rows: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sets = 1 << len(FILTERS)
    counted = failed.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by_set = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("fails") == m, F.col(c))), F.lit(0)).cast("long") for m in range(sets))).alias(c)
    parts = counted.groupBy("part").agg(by_set("n"), by_set("good"), by_set("toxic"))
    step = F.split("row", "[|]")
    rows = parts.withColumn("row", F.explode(_steps())).select("part", "n", "good", "toxic", step[0].alias("filter_order"), step[1].cast("int").alias("step"), step[2].cast("int").alias("bit"), step[3].cast("int").alias("before"))
    bit, before = F.col("bit"), F.col("before")

    def total(counts: str, which, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(sets - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(which(m), F.get(counts, m) * weight(m)).otherwise(0))

    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    now = lambda m: fails(m) & ~earlier(m)
    orders = len(list(itertools.permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("n", now).alias("removed"), total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"), total("good", now).alias("good_lost"), total("toxic", now).alias("toxic_lost"),
        # of the filters that a row fails, each is the first one in an equal share of the orders
        total("n", fails, lambda m: (F.lit(orders) / F.bit_count(m)).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters on doc_id, source and text of docs.

    A null or empty text has no words, so it fails A and not B; null texts equal empty ones. A row fails E if a smaller
    doc_id has its text: rows that repeat the smallest do not, nor do rows without an id. Rows without a source make the
    part "". Repeated labels of a document count once, if one of them says so. An empty table gives no rows; other columns
    are not read.
    """
    return interactions(failures(docs, labels))


def oracle() -> str:
    words = r"list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    return f"""WITH d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t, {words} AS w FROM documents),
    l AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    m AS (SELECT part, CASE WHEN len(w) < {WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {SHARE} * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN d.doc_id > MIN(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
    c AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM m GROUP BY 1, 2),
    f(x, b) AS (VALUES {letters}),
    o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p JOIN f q ON q.b <> p.b JOIN f r ON r.b NOT IN (p.b, q.b) JOIN f s ON s.b NOT IN (p.b, q.b, r.b) JOIN f t ON t.b NOT IN (p.b, q.b, r.b, s.b)),
    k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(COALESCE(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step))
    SELECT part, filter_order, step, CAST(SUM(CASE WHEN fails & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(SUM(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(SUM(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(SUM(CASE WHEN fails & bit <> 0 THEN n * (120 // bit_count(fails)) ELSE 0 END) AS BIGINT) AS shapley FROM c, k GROUP BY 1, 2, 3"""
