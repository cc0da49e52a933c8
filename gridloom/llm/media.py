"""Media columns: text payloads as baseline JPEG, and features from a DC-only decode.

Every payload byte becomes one 8x8 block of constant brightness in a grayscale baseline JPEG: with a
quantiser of 8 the block's DC coefficient is the byte minus 128, its AC coefficients are zero, and every
sample of the decoded picture is the byte itself. The 1/8-size luminance thumbnail, which needs the DC
coefficients only, is therefore the payload: reading it back is lossless.

A row is 192 blocks wide and one restart interval long, so that rows decode independently: the decoder steps
through the symbols of thousands of intervals at once in numpy. Payloads of more than 8,191 rows continue in
further pictures, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WIDTH = 192  # blocks in a row; payloads are padded to a multiple of it
MAX_ROWS = 8191  # 65,535 samples at most, 8 a block
ROWS_AT_ONCE = 4096  # rows that are coded together: bounds a task's memory
QUANT = 8

# DC code lengths by size category; text mostly has differences of 2 to 31, and of 64 to 127 around spaces.
DC_BITS = {2: [7], 3: [2, 3, 4, 5], 4: [0, 1, 6], 5: [8]}
AC_BITS = {1: [0x00]}  # end of block only


def huffman_codes(bits: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical order."""
    out, code, last = {}, 0, 0
    for length in sorted(bits):
        code <<= length - last
        last = length
        for symbol in bits[length]:
            out[symbol] = (code, length)
            code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, bits: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(bits.get(n, ())) for n in range(1, 17)), *(s for n in sorted(bits) for s in bits[n])])


@lru_cache(maxsize=256)
def header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, bytes([0]) + bytes([QUANT] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, _table(0x00, DC_BITS) + _table(0x10, AC_BITS)),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


@lru_cache(maxsize=1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Code word (DC code, value bits, end of block) and its length for each difference + 255."""
    dc, (eob, eob_n) = huffman_codes(DC_BITS), huffman_codes(AC_BITS)[0]
    word, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        value = d if d >= 0 else d + (1 << size) - 1
        word[d + 255], length[d + 255] = (((code << size) | value) << eob_n) | eob, n + size + eob_n
    return word, length


def encode_rows(samples: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-code rows of blocks. samples: (rows, WIDTH) bytes; first: which rows begin a picture; number: a row's number in its picture. Returns the bytes with stuffing and restart markers before every row that does not begin a picture, and where each row begins."""
    word, length = _encoder()
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1].astype(np.int16)
    diff[:, 0] -= 128
    diff += 255
    n = length[diff]
    ends = np.cumsum(n, axis=1)
    row_bits = ends[:, -1]
    row_bytes = (row_bits + 7) >> 3
    row_end = np.cumsum(row_bytes)
    start = (ends - n) + ((row_end - row_bytes) << 3)[:, None]
    value = (word[diff] << (24 - n - (start & 7)).astype(np.uint32)).ravel()
    at = (start >> 3).ravel()
    size = int(row_end[-1]) + 2
    packed = np.bincount(at, (value >> 16) & 255, size) + np.bincount(at + 1, (value >> 8) & 255, size) + np.bincount(at + 2, value & 255, size)
    packed = packed[: size - 2].astype(np.uint8)
    packed[row_end - 1] |= ((1 << ((row_bytes << 3) - row_bits)) - 1).astype(np.uint8)  # the last byte's rest: ones
    stuffed = packed == 0xFF
    marked = ~first
    shift = np.cumsum(stuffed) - stuffed
    before = 2 * np.cumsum(marked)
    place = np.arange(packed.size) + shift + np.repeat(before, row_bytes)
    out = np.zeros(packed.size + int(stuffed.sum()) + int(before[-1]), np.uint8)
    out[place] = packed
    begin = place[row_end - row_bytes]
    out[begin[marked] - 2] = 0xFF
    out[begin[marked] - 1] = 0xD0 + ((number[marked] - 1) & 7)
    return out, begin


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream (one or more pictures) for each payload; each payload is a positive multiple of WIDTH long."""
    parts: list[list[bytes]] = [[] for _ in payloads]
    todo: list[tuple[int, int, int]] = []  # payload, first row, rows
    for k, p in enumerate(payloads):
        total = len(p) // WIDTH
        todo += [(k, r, min(MAX_ROWS, total - r)) for r in range(0, total, MAX_ROWS)]
    at = 0
    while at < len(todo):
        group, rows = [], 0
        while at < len(todo) and (not group or rows + todo[at][2] <= ROWS_AT_ONCE):
            group.append(todo[at])
            rows += todo[at][2]
            at += 1
        samples = np.frombuffer(b"".join(payloads[k][r * WIDTH : (r + n) * WIDTH] for k, r, n in group), np.uint8).reshape(-1, WIDTH)
        counts = np.array([n for _, _, n in group])
        starts = np.cumsum(counts) - counts
        first = np.zeros(rows, bool)
        first[starts] = True
        number = np.arange(rows) - np.repeat(starts, counts)
        out, begin = encode_rows(samples, first, number)
        cut = [*begin[starts].tolist(), out.size]
        data = out.tobytes()
        for (k, _, n), a, b in zip(group, cut, cut[1:]):
            parts[k] += [header(n), data[a:b], b"\xff\xd9"]
    return [b"".join(p) for p in parts]


class Picture:
    """What the markers of one baseline JPEG say, and where its scan lies."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        self.quant: dict[int, int] = {}
        self.huff: dict[int, bytes] = {}
        self.interval, at = 0, at + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC0:
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline pictures are read")
            elif kind == 0xC4:
                while body:
                    count = 17 + sum(body[1:17])
                    self.huff[body[0]], body = body[1:count], body[count:]
            elif kind == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif kind == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.high, self.wide = max(p[2] for p in self.parts), max(p[1] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.high))
        #: Of each block of a unit: its component and its tables.
        self.blocks = [(c, self.huff[tables[i] >> 4], self.huff[0x10 | (tables[i] & 15)]) for c, (i, h, v, _) in enumerate(self.parts) for _ in range(h * v)]
        self.scan = at

    def units(self) -> int:
        return self.across * self.down


def _canonical(table: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a DHT body."""
    out, code, at = [], 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out.append((code, n, table[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=32)
def _lengths(table: bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    look = np.zeros(65536, np.int32)
    for code, n, symbol in _canonical(table):
        look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return look


@lru_cache(maxsize=32)
def _whole_block(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits: (difference + 2048) << 8 | bits of a whole block without AC values; 0 where it is longer or has some."""
    first, second = _lengths(dc), _lengths(ac)
    bits = np.arange(65536, dtype=np.int64)
    n, size = first >> 8, first & 255
    value = ((bits << n) & 0xFFFF) >> (16 - np.minimum(size, 16))
    diff = np.where(size == 0, 0, np.where(value >> np.maximum(size - 1, 0) == 1, value, value - (1 << np.minimum(size, 16)) + 1))
    used = n + size
    rest = second[(bits << np.minimum(used, 16)) & 0xFFFF]
    total = used + (rest >> 8)
    return np.where((n > 0) & (rest > 0) & ((rest & 255) == 0) & (total <= 16), (diff + 2048) << 8 | total, 0).astype(np.int64)


def _one_block(data: np.ndarray, bit: int, dc: bytes, ac: bytes) -> tuple[int, int]:
    """A block bit by bit: (difference, next bit). For the blocks that _whole_block leaves."""

    def peek(at: int) -> int:
        b = data[at >> 3 : (at >> 3) + 3].tolist()
        return ((b[0] << 16 | b[1] << 8 | b[2]) >> (8 - (at & 7))) & 0xFFFF

    look = int(_lengths(dc)[peek(bit)])
    size, bit = look & 255, bit + (look >> 8)
    value = peek(bit) >> (16 - size) if size else 0
    diff, bit, k = (value if not size or value >> (size - 1) else value - (1 << size) + 1), bit + size, 1
    look_ac = _lengths(ac)
    while k < 64:
        look = int(look_ac[peek(bit)])
        if not look:
            raise ValueError("no such code")
        run, size = (look & 255) >> 4, look & 15
        bit += (look >> 8) + size
        if not look & 255:
            break
        k += run + 1
    return diff, bit


def decode_dc(pictures: list[tuple[bytes, Picture]]) -> list[np.ndarray]:
    """The luminance DC thumbnails (uint8, height x width in blocks) of pictures that share their tables."""
    like = pictures[0][1]
    lanes, chunks, base = [], [], 0  # lane: picture, first unit, units, first byte
    for k, (data, p) in enumerate(pictures):
        end = data.find(b"\xff\xd9", p.scan)
        raw = np.frombuffer(data, np.uint8)[p.scan : end if end >= 0 else len(data)]
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        stops = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(raw.size, bool)
        keep[ff[after == 0] + 1] = False
        keep[stops] = keep[stops + 1] = False
        kept = np.cumsum(keep) - keep
        starts = [0, *kept[stops].tolist()]
        each = p.interval or p.units()
        for i, s in enumerate(starts):
            if i * each < p.units():
                lanes.append((k, i * each, min(each, p.units() - i * each), base + s))
        chunks.append(raw[keep])
        base += chunks[-1].size
    flat = np.concatenate([*chunks, np.full(8, 255, np.uint8)])
    wide = flat.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    units = np.array([x[2] for x in lanes])
    order = np.argsort(-units, kind="stable")
    units = units[order]
    bit = np.array([x[3] for x in lanes], np.int64)[order] << 3
    per = len(like.blocks)
    luminance = [i for i, b in enumerate(like.blocks) if b[0] == 0]
    found = np.zeros((len(lanes), int(units[0]) * len(luminance)), np.int16)
    level = np.zeros((len(like.parts), len(lanes)), np.int64)
    for u in range(int(units[0])):
        live = int(np.searchsorted(-units, -u, "left"))  # lanes are sorted by length: the live ones come first
        for j, (part, dc, ac) in enumerate(like.blocks):
            at = bit[:live]
            look = _whole_block(dc, ac)[(window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF]
            step, used = (look >> 8) - 2048, look & 255
            for i in np.flatnonzero(look == 0).tolist():
                d, after_bit = _one_block(flat, int(at[i]), dc, ac)
                step[i], used[i] = d, after_bit - int(at[i])
            level[part, :live] += step
            bit[:live] += used
            if part == 0:
                found[:live, u * len(luminance) + luminance.index(j)] = level[0, :live]
    assert per >= 1
    place = {int(o): i for i, o in enumerate(order)}
    out: list[list[np.ndarray]] = [[] for _ in pictures]
    for i, (k, _, n, _) in enumerate(lanes):
        out[k].append(found[place[i], : n * len(luminance)])
    thumbs = []
    for (_, p), rows in zip(pictures, out):
        _, h, v, q = p.parts[0]
        dc = np.concatenate(rows).astype(np.int32) * p.quant[q]
        pixels = np.clip(np.rint(dc / 8) + 128, 0, 255).astype(np.uint8)
        grid = pixels.reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
        thumbs.append(grid[: -(-p.height // 8), : -(-p.width // 8)])
    return thumbs


def pictures_of(data: bytes) -> list[Picture]:
    out, at = [], 0
    while at < len(data):
        out.append(Picture(data, at))
        at = data.index(b"\xff\xd9", out[-1].scan) + 2  # 0xFF in a scan is followed by 0x00 or a restart marker
    return out


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each stream the DC-only luminance thumbnails of its pictures."""
    groups: dict[tuple, list[tuple[int, int, bytes, Picture]]] = {}
    for k, data in enumerate(media):
        for n, p in enumerate(pictures_of(data)):
            groups.setdefault((tuple(p.blocks), tuple(p.parts)), []).append((k, n, data, p))
    out: dict[tuple[int, int], np.ndarray] = {}
    for members in groups.values():
        at = 0
        while at < len(members):
            some, units = [], 0
            while at < len(members) and (not some or units + members[at][3].units() <= ROWS_AT_ONCE * WIDTH):
                some.append(members[at])
                units += members[at][3].units()
                at += 1
            for (k, n, _, _), t in zip(some, decode_dc([(d, p) for _, _, d, p in some])):
                out[k, n] = t
    return [[out[k, n] for n in range(sum(1 for key in out if key[0] == k))] if len(media) < 2 else _in_order(out, k) for k in range(len(media))]


def _in_order(out: dict[tuple[int, int], np.ndarray], k: int) -> list[np.ndarray]:
    pages, n = [], 0
    while (k, n) in out:
        pages.append(out[k, n])
        n += 1
    return pages


def difference_hash(thumb: np.ndarray) -> str:
    """64-bit dHash: the thumbnail's means on a 8 x 9 grid, each compared with its right neighbour."""
    h, w = thumb.shape
    rows, cols = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r1, c1 = np.maximum(rows[1:], rows[:-1] + 1).clip(max=h), np.maximum(cols[1:], cols[:-1] + 1).clip(max=w)
    r0, c0 = np.minimum(rows[:-1], h - 1), np.minimum(cols[:-1], w - 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None]
    mean = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / area
    return f"{int.from_bytes(np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes(), 'big'):016x}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _features(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, 512):
            some = [padded(t) for t in texts.slice(lo, 512).to_pylist()]
            media = encode([p for _, p in some])
            rows = []
            for (n, _), data, thumbs in zip(some, media, thumbnails(media)):
                back = b"".join(t.tobytes() for t in thumbs)
                sizes = "+".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}" for t in thumbs)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                             f"{sizes}:{difference_hash(thumbs[0])}:{xxhash.xxh3_64_hexdigest(back)}"))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, 512).cast(schema.field(0).type), *cols], schema=schema)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id and what the stored JPEG of each text says when it is read back; see the module's docstring.

    Null text counts as empty (a payload of 192 spaces); repeated rows give repeated rows; an empty table gives none; other columns are not looked at. Rows never leave their partition.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    arrow = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.strip().split(" ") for c in schema.split(","))])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _features(batches, arrow), schema)
