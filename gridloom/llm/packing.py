"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree.

Documents are dealt at random (a hash of id, text, task and number among equal rows) into groups of about GROUP documents, so the number of
groups grows with the input and a group stays small; each is packed on its own. In a group, a document first
gives full sequences; what is left of it (under one sequence) goes to the first bin that still has room, the
longest remainder first. A tournament tree over the bins' free space finds that bin in log2(bins) steps.
Documents may be cut: pieces of the emptiest bins then fill the gaps of the others, and the one bin that stays
part-full is cut at powers of two, sizes which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024  # tokens in a sequence
GROUP = 1024  # documents in a randomised group, on average
CACHED = 400_000  # words whose ids a Python worker remembers
REMEMBERED = 1_000_000  # different rows that a task remembers to tell copies apart
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokens:
    """ids of a byte-level BPE by the tokenizers library, word by word with a bounded memory of words.

    The vocabulary's pattern never joins characters across a space that a non-space follows, so the words
    between single spaces encode on their own. Texts in which another white space stands after a space, and
    texts with the special token, go whole through the library.
    """

    ODD = re.compile(r" (?=\s)| \Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.quick = self._ranked()

    def _ranked(self):
        """The same merges in a faster library, for words of common scripts (whose pattern classes both agree on)."""
        try:
            import json

            import tiktoken
            from public_tokenizers import PATTERN
        except ImportError:
            return None
        model = json.loads(self.tokenizer.to_str())["model"]
        byte = {c: b for b, c in byte_letters().items()}
        try:
            ranks = {bytes(byte[c] for c in piece): n for piece, n in model["vocab"].items() if piece not in self.special}
        except KeyError:
            return None
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if self.quick is not None and (text.isascii() or max(text) < "ɐ") and not any(s in text for s in self.special):
            return self.quick.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The text's ids, two bytes each, low byte first."""
        if not text:
            return b""
        if self.ODD.search(text) or any(s in text for s in self.special):
            return np.array(self._ids(text), "<u2").tobytes()
        first, *words = text.split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHED:
                self.known.clear()
            for i, got in enumerate(found):
                if got is None:
                    word = words[i]
                    got = self.known.get(word)
                    if got is None:
                        got = self.known[word] = np.array(self._ids(" " + word), "<u2").tobytes()
                    found[i] = got
        return np.array(self._ids(first), "<u2").tobytes() + b"".join(found)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_loaded: dict[str, ByteTokens] = {}


def tokens_of(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


class Tournament:
    """A complete tree whose leaves hold the bins' free space and whose nodes hold the largest below."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take size from the first bin that has room, and return that bin."""
        node, best = 1, self.best
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        found = node - self.leaves
        best[node] -= size
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return found


def pack(lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length). Each token of each document is in one piece; every sequence is full or a power of two long."""
    out, rest = [], []
    for d, n in enumerate(lengths):
        out += [[(d, at, size)] for at in range(0, n - n % size, size)]
        if n % size:
            rest.append((n % size, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), size), []
    for n, d in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, lengths[d] - n, n))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    lo, hi = 0, len(order) - 1
    while lo < hi:
        need, donor = size - fill[order[lo]], bins[order[hi]]
        if not need:
            lo += 1
            continue
        d, start, n = donor.pop()
        take = min(need, n)
        if take < n:
            donor.append((d, start, n - take))
        bins[order[lo]].append((d, start + n - take, take))
        fill[order[lo]] += take
        fill[order[hi]] -= take
        if not donor:
            hi -= 1
    for b in order:
        if fill[b] == size:
            out.append(bins[b])
        elif fill[b]:
            out += _binary(bins[b], fill[b])
    return out


def _binary(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut a part-full bin into sequences of powers of two."""
    out, pieces = [], pieces[::-1]
    for power in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        now = []
        while power:
            d, start, n = pieces.pop()
            take = min(power, n)
            now.append((d, start, take))
            power -= take
            if take < n:
                pieces.append((d, start + take, n - take))
        out.append(now)
    return out


def _encode(batches: Iterator[pa.RecordBatch], path: str, groups: int) -> Iterator[pa.RecordBatch]:
    """(row's hash, doc_id, text) -> team, doc_id, ids. The copies of a row go to different teams: each by its number among the copies in the task. A task that runs again deals out as many to each."""
    tokens, part, copies = tokens_of(path), TaskContext.get().partitionId(), {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            some = batch.slice(lo, 1024)
            ids = [tokens.encode(t or "") + b"\0\0" for t in some.column(2).to_pylist()]
            if len(copies) > REMEMBERED:
                copies.clear()
            teams = []
            for row in some.column(0).to_pylist():
                nth = copies[row] = copies.get(row, -1) + 1
                teams.append(hash((row, part, nth)) % groups)
            yield pa.RecordBatch.from_arrays([pa.array(teams, pa.int64()), some.column(1).cast(pa.int64()), pa.array(ids, pa.binary())], ["team", "doc_id", "ids"])


def _pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    (team,) = key
    raw = table.column("ids").to_pylist()
    docs = table.column("doc_id").to_pylist()
    order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0, raw[i]))
    ids, docs = [np.frombuffer(raw[i], "<u2").astype("<u4") for i in order], [docs[i] for i in order]
    rows = []
    for n, sequence in enumerate(pack([len(x) for x in ids])):
        offset = 0
        for d, start, length in sequence:
            rows.append((docs[d], start, length, zlib.crc32(ids[d][start : start + length].tobytes()), len(ids[d]), (team.as_py() << 32) + n, offset))
            offset += length
    names = [c.strip().split(" ")[0] for c in PIECES.split(",")]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*rows))})


def pack_documents(docs: DataFrame, tokenizer: str, group: int = GROUP) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence.

    A null or empty text is the one token 0; repeated rows are packed as rows of their own; ties between equal remainders go to the smaller id; an empty table gives no rows; only doc_id and text are read. Encoding happens once, before the only shuffle, which moves ids of two bytes.
    """
    groups = max(1, -(-docs.count() // group))
    row = F.xxhash64("doc_id", "text")
    dealt = docs.select(row.alias("row"), "doc_id", "text").mapInArrow(lambda batches: _encode(batches, tokenizer, groups), "team long, doc_id long, ids binary")
    return dealt.groupBy("team").applyInArrow(_pack_group, PIECES)
