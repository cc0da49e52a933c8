"""BPE encoding and decoding through a table of distinct words.

Spark splits all texts into words and counts the distinct ones. The HOT most frequent are encoded once each,
in Spark, and decoded through a join of their ids with the id-to-piece table (bounded by the vocabulary). That
table has a fixed bound, so it is broadcast and joined back by position inside the scan of the texts: no text
and no occurrence is shuffled, and very common words make no hot key. Rarer words are encoded by the task that
meets them, with a bounded memory: exact, and far less to move than a join by position of all occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, threshold

HOT = 131_072  # rows of the broadcast word table
LONGEST = 64  # characters of a word in it: bounds its bytes
CACHED = 200_000  # rarer words that a Python worker remembers

_tokenizers: dict[str, object] = {}
_memory: dict[str, dict[bytes, tuple[int, bytes, bytes]]] = {}


def tokenizer_of(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _tokenizers[path] = found
    return _tokenizers[path]


def distinct_words(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all texts between ASCII white space, which no token spans."""
    words = docs.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = tokenizer_of(path)
    for batch in batches:
        words = batch.column(0).to_pylist()
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: the vocabulary, as many rows as it has."""
    return spark.createDataFrame([(i, p) for p, i in tokenizer_of(path).get_vocab(with_added_tokens=True).items()], "id int, piece string")


def word_table(words: DataFrame, path: str) -> DataFrame:
    """word, ids, decoded of distinct words; decoded is the join of their ids with the pieces, in order."""
    encoded = words.select("word").mapInArrow(lambda batches: _encode_words(batches, path), "word string, ids array<int>")
    spread = encoded.select("word", "ids", F.posexplode_outer("ids").alias("pos", "id"))
    joined = spread.join(F.broadcast(pieces(words.sparkSession, path)), "id", "left")
    decoded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")
    return joined.groupBy("word").agg(F.first("ids").alias("ids"), decoded.alias("decoded"))


def hot_words(docs: DataFrame, path: str, hot: int = HOT) -> dict[bytes, tuple[int, bytes, bytes]]:
    """The most frequent words with their number of ids, their ids and their decoded form; at most `hot` short words."""
    counts = materialise(distinct_words(docs).where(F.length("word") <= LONGEST), "words")
    rows = word_table(counts.where(F.col("n") >= threshold(counts, hot)), path).toArrow()
    return {w.encode(): (len(i), " ".join(map(str, i)).encode(), d.encode()) for w, i, d in zip(*(rows.column(c).to_pylist() for c in ("word", "ids", "decoded")))}


def _digests(batches: Iterator[pa.RecordBatch], path: str, hot, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table, tokenizer = hot.value, tokenizer_of(path)
    rare = _memory.setdefault(path, {})
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            split = [(t or "").encode("utf-8", "surrogatepass").split() for t in some.column(1).to_pylist()]
            if len(rare) > CACHED:
                for w in list(islice(rare, CACHED // 2)):  # the older half
                    del rare[w]
            new = [w for w in set().union(*split) if w not in table and w not in rare]
            for w, e in zip(new, tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)):
                rare[w] = (len(e.ids), " ".join(map(str, e.ids)).encode(), " ".join(map(tokenizer.id_to_token, e.ids)).encode())
            rows = []
            for words in split:
                found = [table.get(w) or rare[w] for w in words]
                n, ids, decoded = zip(*found) if found else ((), (), ())
                rows.append((sum(n), hashlib.sha256(b" ".join(filter(None, ids))).hexdigest(), hashlib.sha256(b" ".join(filter(None, decoded))).hexdigest()))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), *cols], schema=schema)


def encode_digests(docs: DataFrame, tokenizer: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text.

    A null text counts as empty and has no ids; repeated rows give repeated rows; an empty table gives none; only doc_id and text are read.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(hot_words(docs, tokenizer, hot))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _digests(batches, tokenizer, table, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
