"""Document fingerprints by I-Match, with DataFrame functions only.

Document frequencies of all words come from all texts. Words are counted by SLOTS hash slots, far more than there
are words in the band, so that the counts have a fixed size: rare words that share a slot stay rare. The lexicon
holds the slots whose share of documents lies in a band of inverse document frequency, neither the words of every
text nor the rare ones, as one array of bits: a scalar of SLOTS / 8 bytes, whatever the corpus' size, which every
task looks words up in without a join. The lexicon is dealt at random into LEXICONS subsets; a document's
fingerprint has, for each subset that it has words of, the subset's number and a hash of the document's sorted
distinct words in it.

A text without lexicon words uses all its words instead, and a text without words itself, so that equal texts
always have equal fingerprints and other texts hardly do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_KEYS, materialise, semi_join, within

LOW, HIGH = 0.0005, 0.05  # the band: shares of documents that have a word
LEAST = 2  # documents that have it at least
SLOTS = 1 << 22
LEXICONS = 256
ENTRY = 8  # letters of a fingerprint's entry: two for the subset, six for the hash
BUCKET = 512  # documents in a bucket of neighbours, about
RUN = 65_536  # copies of a row in one array
FULL = 8  # times as many, and a bucket is dealt again


def terms(text: Column) -> Column:
    """A text's distinct words in lower case: runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1).cast("long"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """slot, df over all texts."""
    return docs.select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), slot))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """bits: one row, an array of SLOTS / 64 longs with the bits of the slots in the band."""
    n = docs.count()
    band = document_frequency(docs).where((F.col("df") >= max(LEAST, low * n)) & (F.col("df") <= max(LEAST, high * n)))
    words = band.groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word"))
    blank = docs.sparkSession.range(SLOTS // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    whole = words.union(blank).groupBy("at").agg(F.bit_or("word").alias("word"))
    bits = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("bits"))
    return materialise(bits, "lexicon")


def known(words: Column, bits: Column) -> Column:
    """The words whose slots are in the lexicon; bits: the lexicon as a column."""

    def inside(w: Column) -> Column:
        at = slot(w)
        return F.call_function("getbit", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return F.filter(words, inside)


def entries(text: Column, words: Column, hits: Column) -> Column:
    """The entries of a text's fingerprint, with its terms and those of them in the lexicon."""
    used = F.when(F.size(hits) > 0, hits).when(F.size(words) > 0, words).otherwise(F.array(F.coalesce(text, F.lit(""))))
    # "ss" and the word, sorted: a subset's words follow each other.
    dealt = F.array_sort(F.transform(used, lambda w: F.concat(F.lpad(F.hex(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(LEXICONS))), 2, "0"), w)))
    start = F.struct(F.lit("").alias("subset"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("done"))
    closed = lambda acc: F.when(acc["subset"] == "", F.lit("")).otherwise(F.concat(acc["done"], acc["subset"], F.lower(F.substring(F.lpad(F.hex(acc["hash"]), 16, "0"), 1, ENTRY - 2)), F.lit(" ")))

    def step(acc: Column, w: Column) -> Column:
        subset, same = F.substring(w, 1, 2), F.substring(w, 1, 2) == acc["subset"]
        return F.struct(subset.alias("subset"), F.xxhash64(F.when(same, acc["hash"]).otherwise(F.lit(0).cast("long")), w).alias("hash"), F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"))

    return F.split(F.rtrim(F.aggregate(dealt, start, step, closed)), " ")


def subsets(found: Column) -> Column:
    return F.transform(found, lambda e: F.substring(e, 1, 2))


def likeness(a: Column, b: Column, a_subsets: Column, b_subsets: Column) -> Column:
    """The share of equal entries among the subsets that either fingerprint has."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a_subsets, b_subsets))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text, copies: of each document the next one in descending doc_id; after the last comes the first.

    Neighbours meet in buckets of ids, in one shuffle of the texts. The first document of each bucket also goes, as a
    guest, to the end of the bucket before it: the neighbour of that one's last document. Null ids come last. Rows of
    one doc_id that fill more than FULL buckets, and null ids, are dealt to lots by a hash of their texts, and equal
    ones among them travel as one row with their number: all but the last have themselves as next. Within a lot, and
    among rows of any other doc_id, the smaller text comes first. A row stands for `copies` equal ones.
    """
    rows, buckets = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    tops = buckets.select(F.col("top").alias("doc_id")).where("top is not null").distinct()
    first = semi_join(rows, tops, "doc_id").union(rows.where("doc_id is null"))
    # The largest id and its smallest text; a lot has one id only.
    heads = first.groupBy(F.col("bucket").alias("next_bucket")).agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    guests = heads.join(_next_bucket(buckets), "next_bucket").select("doc_id", "text", "bucket", F.lit(0).cast("long").alias("copies"), F.lit(1).alias("guest"))
    own = rows.where("not lot").select("doc_id", "text", "bucket", F.lit(1).cast("long").alias("copies"))
    lots = not buckets.where("lot").isEmpty()
    if lots:
        own = own.union(rows.where("lot").groupBy("doc_id", "text", "bucket").agg(F.count(F.lit(1)).alias("copies")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    near = own.withColumn("guest", F.lit(0)).union(guests).withColumns({"next_id": F.lead("doc_id").over(order), "next_text": F.lead("text").over(order)}).where("guest = 0")
    if not lots:
        return near.select("doc_id", "text", "next_id", "next_text", "copies")
    last = F.struct("next_id", "next_text", F.lit(1).cast("long").alias("copies"))
    others = F.struct(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), (F.col("copies") - 1).alias("copies"))
    return near.select("doc_id", "text", F.inline(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, bucket, lot for every row; and the buckets: bucket, lot, top (largest id).

    A bucket is a path of numbers. Ids are dealt by a width that follows from their range and number; a bucket that
    holds more than FULL times its share is dealt again by its own range, so that dense ids beside a few outlying ones
    are parted, too. Each round cuts a bucket's range to a quarter at most; a bucket of one id is dealt to lots.
    Only ids are read for this, and the rows' own buckets follow from the tables of widths.
    """
    size = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    width, lots = width_of(size.low, size.high, size.n), -(-size.nameless // BUCKET) or 1
    step = F.call_function("div", F.col("doc_id"), F.lit(width).cast("long"))
    nameless = F.pmod(F.xxhash64("text"), F.lit(lots))
    rows = rows.withColumns({"bucket": F.when(F.col("doc_id").isNull(), F.array(F.lit(None).cast("long"), nameless)).otherwise(F.array(step)), "lot": F.col("doc_id").isNull()})
    while True:
        buckets = materialise(rows.groupBy("bucket", "lot").agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "buckets")
        span = F.expr("cast(top as decimal(20, 0)) - cast(least as decimal(20, 0)) + 1")
        full = buckets.where((F.col("n") > FULL * BUCKET) & ~F.col("lot")).select("bucket", (F.col("top") == F.col("least")).alias("single"), F.floor(F.greatest(F.lit(1), F.least(span * BUCKET / F.col("n"), F.lit(2**62)))).cast("long").alias("width"), F.ceil(F.col("n") / BUCKET).cast("long").alias("lots"))
        if full.isEmpty():
            return rows, buckets.select("bucket", "lot", "top")
        part = F.when(F.col("single"), F.pmod(F.xxhash64("text"), F.col("lots"))).otherwise(F.expr("doc_id div width"))
        side = F.broadcast(full) if within(full, BROADCAST_KEYS // 8) else full
        rows = rows.join(side, "bucket", "left").select("doc_id", "text", F.when(F.col("width").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.array(part))).alias("bucket"), F.coalesce("single", "lot").alias("lot"))


def width_of(low: int | None, high: int | None, n: int) -> int:
    """How many ids a bucket spans, so that n ids between low and high fill buckets of BUCKET documents on average."""
    return min(max(1, (high - low + 1) * BUCKET // n), 2**62) if n else 1


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """bucket, next_bucket: the next one in descending order of ids, lots of one id by their numbers; after the last comes the first. Ranges of buckets are ordered on their own; only their ends are ordered together."""
    order = [F.desc_nulls_last("top"), F.asc("bucket")]
    ranges = max(1, buckets.count() // 65_536)
    wide = materialise(buckets.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "bucket-ranges")
    stepped = wide.withColumn("next_bucket", F.lead("bucket").over(Window.partitionBy("range").orderBy(*order)))
    ends = wide.groupBy("range").agg(F.min_by("bucket", F.struct(F.col("top").isNull(), -F.col("top").cast("decimal(20, 0)"), "bucket")).alias("start"))
    line = Window.orderBy("range")
    ends = ends.select("range", F.coalesce(F.lead("start").over(line), F.first("start").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return stepped.join(ends, "range").select("bucket", F.coalesce("next_bucket", "after").alias("next_bucket"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by as many first ones of the following text, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    Null text counts as empty. Repeated rows give repeated rows, computed once where they are many; a lone document is
    its own next one. An empty table gives none. Only doc_id and text are read.
    """
    bits = lexicon(docs).scalar()
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # One select after the other: what a later one uses twice is computed once. A scalar subquery may not stand in a
    # lambda, so it becomes a column for one step.
    texts = {"a": "text", "b": "edited", "c": "next_text"}
    split = pairs.withColumns({k: terms(F.col(t)) for k, t in texts.items()})
    met = split.withColumn("bits", bits).withColumns({f"{k}_hits": known(F.col(k), F.col("bits")) for k in texts}).drop("bits")
    # The next document's fingerprint is made again from its text, which is here: cheaper than to move all fingerprints.
    prints = met.select("doc_id", "copies", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(entries(F.col(t), F.col(k), F.col(f"{k}_hits")).alias(k) for k, t in texts.items()))
    wide = prints.withColumns({f"{k}_subsets": subsets(F.col(k)) for k in texts})
    near = lambda other: likeness(F.col("a"), F.col(other), F.col("a_subsets"), F.col(f"{other}_subsets"))
    out = wide.select("copies", "doc_id", "n_chars", "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("b", "").alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))
    # Copies in runs, so that no row carries an array as long as there are copies.
    runs = out.withColumn("start", F.explode(F.expr(f"sequence(1L, copies, {RUN}L)")))
    return runs.withColumn("copy", F.explode(F.expr(f"sequence(start, least(start + {RUN - 1}L, copies))"))).drop("copies", "start", "copy")
