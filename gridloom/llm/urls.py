"""URL filters: a sorted array of 64-bit digests, memory-mapped, with the full strings behind it.

A list of hosts or of "host/path" prefixes is written once into one file: the sorted xxhash keys, each key's
offset into the strings, then the strings. The file travels to the executors (its size is checked: larger lists are
joined by Spark instead), where each Python worker maps it into memory. Only hosts with as many labels and paths with as
many characters as the list has are probed, so long URLs cost no more than short ones. Keys of many URLs are probed with
one vectorised binary search, and each hit is confirmed against the stored string: a collision of digests blocks nothing.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER

#: Kinds of sites that the filter blocks, under each of these domains and with all their subdomains: the demonstration list of the queries.
SITES = ["ad-server", "adult-x", "ads-track", "casino-win", "cheap-pills", "fake-loans", "free-bets", "malware-kit", "phish-login", "porn-hub", "spam-farm", "warez-zone"]
DOMAINS = ["example.com", "example.net", "example.org"]
BLOCKED = [f"{site}.{domain}" for site in SITES for domain in DOMAINS]
LIST_BYTES = 256 << 20  # the largest list that is sent to the executors


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """The file's three parts, mapped: keys, offsets, strings."""

    def __init__(self, data):
        n = int(np.frombuffer(data, "<u8", 1)[0])
        self.keys = np.frombuffer(data, "<u8", n, 8)
        self.offsets = np.frombuffer(data, "<u8", n + 1, 8 + 8 * n)
        self.strings = memoryview(data)[8 + 8 * (2 * n + 1) :]

    @staticmethod
    def build(entries: Iterable[str], key=xxhash.xxh64_intdigest) -> bytes:
        items = sorted({e.encode() for e in entries}, key=lambda e: (key(e), e))
        ends = np.cumsum([0, *map(len, items)]).astype("<u8")
        return np.array([len(items)], "<u8").tobytes() + np.array([key(e) for e in items], "<u8").tobytes() + ends.tobytes() + b"".join(items)

    def contains(self, probes: list[bytes], key=xxhash.xxh64_intdigest) -> np.ndarray:
        """Whether each probe is in the list. Of equal keys all strings are compared."""
        wanted = np.fromiter(map(key, probes), np.uint64, len(probes))
        first, last = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        out = np.zeros(len(probes), bool)
        for i in np.flatnonzero(first < last).tolist():
            out[i] = any(self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])] == probes[i] for j in range(first[i], last[i]))
        return out


_mapped: dict[str, DigestArray] = {}


def mapped(name: str, data: bytes) -> DigestArray:
    """The list in memory-mapped form, once a worker; its file has no name, so nothing stays behind."""
    if name not in _mapped:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            _mapped[name] = DigestArray(mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ))
    return _mapped[name]


def shape_of(entries: Iterable[str]) -> tuple[list[int], list[int]]:
    """How many labels the listed hosts have, and how many characters the listed paths: what has to be probed."""
    parts = [e.partition("/") for e in entries]
    return sorted({h.count(".") + 1 for h, _, _ in parts}), sorted({len(slash + path) for _, slash, path in parts})


def probes_of(host: str, path: str, labels: list[int], lengths: list[int]) -> list[str]:
    """What a list of this shape may name: parent domains, alone or with a leading part of the path that ends in a slash or is all of it."""
    parts = host.rsplit(".", labels[-1])[-labels[-1] :] if host and labels else []
    steps = [path[:n] for n in lengths if n == len(path) or n < len(path) and (not n or path[n - 1] == "/")]
    return [".".join(parts[-n:]) + s for n in labels if n <= len(parts) for s in steps]


def _blocked(batches: Iterator[pa.RecordBatch], name: str, data) -> Iterator[pa.RecordBatch]:
    content, labels, lengths = data.value
    array = mapped(name, content)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            some = batch.slice(lo, 1024)
            probes = [[p.encode() for p in probes_of(h, t, labels, lengths)] for h, t in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
            found = array.contains([p for ps in probes for p in ps])
            ends = np.cumsum([0, *map(len, probes)])
            hit = [bool(found[a:b].any()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(hit, pa.bool_())], [*some.schema.names, "listed"])


def _parts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def listed(pages: DataFrame, entries: list[str] | DataFrame | None = None, most: int = LIST_BYTES) -> DataFrame:
    """page_id, host, path, listed for pages(page_id, url). entries: hosts, or hosts with a path, in lower case, as a list or as a table entry.

    A list of up to `most` bytes goes to the workers as a digest array; beyond that Spark joins. Null URLs and those
    without :// are never listed; repeated rows give repeated rows; null entries list nothing; empty tables give none.
    """
    entries = BLOCKED if entries is None else entries
    spark = pages.sparkSession
    if isinstance(entries, DataFrame):
        entries = entries.select("entry").where("entry <> ''").distinct()
        size = entries.agg(F.coalesce(F.sum(F.octet_length("entry") + 16), F.lit(0))).first()[0]
        if size > most:
            return joined(pages, entries)
        entries = [r.entry for r in entries.collect()]
    data = DigestArray.build(entries)
    if len(data) > most:
        return joined(pages, spark.createDataFrame([(e,) for e in entries], "entry string"))
    shared = spark.sparkContext.broadcast((data, *shape_of(entries)))
    name = xxhash.xxh3_128_hexdigest(data)
    return _parts(pages).mapInArrow(lambda b: _blocked(b, name, shared), "page_id long, host string, path string, listed boolean")


def joined(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """As listed(), for lists of any size: entries(entry) is a table, joined by digest and string."""
    table = entries.select("entry").where("entry <> ''").distinct()
    # The list's shape, as shape_of(): as many rows as there are different lengths.
    host = F.substring_index("entry", "/", 1)
    shape = table.select(F.size(F.split(host, r"\.")).alias("labels"), (F.length("entry") - F.length(host)).alias("length"))
    labels, lengths = ([r[0] for r in shape.select(c).distinct().collect()] for c in ("labels", "length"))
    parts = _parts(pages).withColumn("row", F.monotonically_increasing_id())
    if not labels:
        return parts.select("page_id", "host", "path", F.lit(False).alias("listed"))
    ints = lambda xs: F.array(*(F.lit(x) for x in xs))
    n, path = F.size(F.split("host", r"\.")), F.col("path")
    domains = F.transform(F.filter(ints(labels), lambda k: (k <= n) & (F.col("host") != "")), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    steps = F.transform(F.filter(ints(lengths), lambda k: (k == F.length(path)) | (k < F.length(path)) & ((k == 0) | (F.substring(path, k, F.lit(1)) == "/"))), lambda k: F.substring(path, F.lit(1), k))
    probes = F.flatten(F.transform(domains, lambda d: F.transform(steps, lambda s: F.concat(d, s))))
    spread = parts.select("row", F.explode(probes).alias("entry"))
    hits = spread.withColumn("key", F.xxhash64("entry")).join(table.withColumn("key", F.xxhash64("entry")), ["key", "entry"], "left_semi").select("row").distinct()
    return parts.join(hits.withColumn("hit", F.lit(True)), "row", "left").select("page_id", "host", "path", F.coalesce("hit", F.lit(False)).alias("listed"))


#: (verdict, host and path): the longest rule that fits wins.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, entries: list[str] | DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest fitting rule's, else block for listed URLs and allow for others.

    A rule fits its host and all subdomains where the path starts with the rule's path. Null URLs and those without
    :// have an empty host and path, fit no rule and are allowed; repeated rows give repeated rows; an empty table
    gives none. Only page_id and url are read.
    """
    rules = RULES if rules is None else rules
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, so it is added last
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return listed(pages, entries).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def oracle(entries: list[str] | None = None) -> str:
    """The same verdicts in DuckDB's SQL, for lists of hosts."""
    names = BLOCKED if entries is None else entries
    tests = " OR ".join(f"host = '{e}' OR host LIKE '%.{e}'" for e in names)
    cases = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda text: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '/{1}')".format(*text.partition("/")[::2])
    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in cases)
    verdict = " ".join(f"WHEN {fits(t)} THEN '{k}'" for k, t in cases)
    return rf"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT CAST(page_id AS BIGINT) AS page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN {tests} THEN 'block' ELSE 'allow' END AS verdict FROM parts
    """
