"""Language-model scoring: a causal self-attention model in numpy on subword ids.

Texts are lower-cased, split into words and spelled with the pieces of a byte-level BPE (the first piece of a word
carries the space before it); END closes a text. The model sees nothing but these ids. A unit is one of the UNITS
most frequent pieces of the training texts; all other pieces share the unit TAIL and are told apart by their counts.

An input place holds the embeddings of the unit there, of the one before it and of the place. One block of masked
self-attention and a small feed-forward layer follow. The output is a softmax in two steps, both trained: the
class of the next unit, then the unit among those of its class. The SINGLE most frequent units are classes of their
own; the others are grouped by frequency and by the pieces before them inside words, so that groups of frequent units
are small. The counts only lay out the classes and start the biases.

Starting values come from about WARM windows drawn from all training texts by a hash (a bound for the driver); then
every partition trains on windows that cover every unit of all its training texts, and the partitions' parameters
are averaged, weighted by what they saw.

Scoring cuts a text into windows of WINDOW places that overlap by OVERLAP: each unit is scored once, by the window
that gives it the longer context, many windows at a time.

The baseline adds up smoothed counts of words. Frequent words are looked up in a broadcast table (HOT rows at most);
the others are joined with the table of all counts, one row for each text and occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_words, materialise, threshold  # noqa: F401

HOT = 131_072  # frequent words whose counts are broadcast, at most
LONGEST = 64  # bytes of such a word, at most
UNITS = 4096  # pieces with parameters of their own
SINGLE = 64  # classes of one unit
BANDS = ((256, 8), (1024, 12), (UNITS - SINGLE - 1280, 11))  # units by falling frequency, and how many classes they are dealt to
CLASSES = SINGLE + sum(groups for _, groups in BANDS) + 1  # the last one is TAIL's
WINDOW, OVERLAP = 32, 8
WIDTH, KEY, HIDDEN = 16, 8, 32
WARM = 24_000  # windows that the starting values are trained on, about
WARM_STEPS = 600  # batches for the starting values, at least: small samples are gone through again
WARM_BATCH, BATCH = 128, 512  # windows of a training step, for the starting values and after
AT_ONCE = 60  # windows whose hidden states are computed together: what fits a core's cache, in products that are small
SMALL = 1_000_000  # multiplications of a product up to which BLAS does not first copy the matrices to packed ones
STRETCH = 16_384  # parameters that a step changes together
BLOCK = 4096  # windows whose outputs are computed together
HELD = 8192  # windows that a task gathers before it trains on them
LOT = 8_000_000  # bytes of text whose words are handled together
COUNTED = 32_000_000  # bytes of words that a task gathers before it counts them and passes the counts on

#: The largest attention score: the mask of what comes later.
_LIMIT = np.where(np.tri(WINDOW, dtype=bool), np.float32(60), np.float32(-1e9))

_encoders: dict[str, object] = {}
_begins: dict[str, np.ndarray] = {}  # by piece: whether it carries a space


def speller(path: str):
    """word -> ids of its pieces, by a file of ranks; and how many pieces there are."""
    if path not in _encoders:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
    encoding, size = _encoders[path]
    return (lambda word: encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))), size


def spelled(words: list[bytes], path: str) -> list[bytes]:
    """Each word's ids as spell() gives them, 2 bytes each."""
    return spelled_array(pa.array(words, pa.binary()), path).to_pylist()


def spelled_array(words: pa.Array, path: str) -> pa.Array:
    """The same for an array. Words are encoded together: no piece crosses a space, and only a word's first one has it. Those with white space of other kinds, or that are no UTF-8, are encoded alone."""
    spell, size = speller(path)
    if path not in _begins:
        _begins[path] = np.array([_encoders[path][0].decode_single_token_bytes(i)[:1] == b" " for i in range(size)])
    try:
        together = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        text = " " + pc.binary_join(together, b" ")[0].as_py().decode() if len(words) else ""
    except UnicodeDecodeError:
        text = ""
    if len(text.split()) != len(words):
        plain = np.array([_plain(w) for w in words.to_pylist()])
        if not plain.all():
            odd = pa.array([np.array(spell(w), np.uint16).tobytes() for w in words.filter(pa.array(~plain)).to_pylist()], pa.binary())
            together = spelled_array(words.filter(pa.array(plain)), path)
            place = np.where(plain, np.cumsum(plain) - 1, len(together) + np.cumsum(~plain) - 1)
            return pa.concat_arrays([together, odd]).take(pa.array(place))
    ids = np.array(_encoders[path][0].encode_ordinary(text), np.uint16)
    return _binary(np.append(np.flatnonzero(_begins[path][ids]), len(ids)), ids)


def _plain(word: bytes) -> bool:
    try:
        return len(word.decode().split()) == 1
    except UnicodeDecodeError:
        return False


def _binary(edges: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The ids between each edge and the next, 2 bytes each, as an array of bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(ids)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """ascii_words of each text, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, count = lists.flatten(), pc.list_value_length(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not some.all():  # white space at the ends of a text
        ends = np.cumsum(count)
        before = np.concatenate([[0], np.cumsum(some)])
        count, words = before[ends] - before[ends - count], words.filter(pa.array(some))
    return words.cast(pa.binary()), count.astype(np.int64)


def lots(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First and last row of runs of rows of about so many bytes."""
    lot = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(column)]
    return ((lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo)


# ---- Units and classes


@dataclass
class Vocabulary:
    """The units in the order of their classes, so that a class is a slice of them; the last unit is TAIL."""

    unit: np.ndarray  # by piece, END last
    edges: np.ndarray  # the classes' first units, and the number of units
    start: np.ndarray  # by unit: the natural log of its smoothed share in its class
    share: np.ndarray  # by class: the natural log of its smoothed share
    tail: np.ndarray  # by piece: the natural log of its smoothed share of TAIL, 0 for units of their own

    @property
    def end(self) -> int:
        return int(self.unit[-1])

    @property
    def classes(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))


def _halved(at: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Units in an order in which similar ones stand together: split at the median of the first principal axis, again and again."""
    if len(at) <= 8:
        return at
    v = near[at] - near[at].mean(axis=0)
    axis = np.linalg.eigh(v.T @ v)[1][:, -1]
    order = at[np.argsort(v @ axis, kind="stable")]
    half = len(order) // 2
    return np.concatenate([_halved(order[:half], near), _halved(order[half:], near)])


def ranked(counts: np.ndarray) -> np.ndarray:
    """The UNITS - 1 most frequent pieces, the most frequent first; of equal counts the smaller id."""
    return np.argsort(-counts, kind="stable")[: UNITS - 1]


def vocabulary(counts: np.ndarray, near: np.ndarray) -> Vocabulary:
    """counts: by piece, END last; near: for the pieces of ranked(counts), how often each stands behind certain others."""
    order = ranked(counts)
    v = np.log1p(near / np.maximum(near.sum(axis=1, keepdims=True), 1) / np.maximum(near.sum(axis=0) / max(near.sum(), 1), 1e-3))
    groups, at = [np.array([i]) for i in range(SINGLE)], SINGLE
    for size, n in BANDS:
        band = np.arange(at, min(at + size, len(order)))
        groups += np.array_split(_halved(band, v), n)
        at += size
    places = np.concatenate(groups)
    unit = np.full(len(counts), UNITS - 1)
    unit[order[places]] = np.arange(len(places))
    edges = np.cumsum([0, *map(len, groups), 1])
    smoothed = np.bincount(unit, counts, UNITS) + 0.5
    inside = np.add.reduceat(smoothed, edges[:-1])
    tail = np.where(unit == UNITS - 1, counts + 0.5, 1.0)
    tail = np.where(unit == UNITS - 1, np.log(tail) - math.log(max(tail[unit == UNITS - 1].sum(), 0.5)), 0.0)
    return Vocabulary(unit.astype(np.uint16), edges, np.log(smoothed / np.repeat(inside, np.diff(edges))), np.log(inside / inside.sum()), tail)


# ---- The model


def _softmax(h: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of h: exp(logits), their sums, and the natural logs of the targets' shares. Shifted only where it would overflow. Powers of 2 are what numpy computes faster."""
    weight = weight * np.asarray(math.log2(math.e), weight.dtype)
    logits = h @ weight
    width = logits.shape[1]
    place, ones = np.arange(0, logits.size, width) + target, np.ones(width, logits.dtype)
    own = np.take(logits, place)
    with np.errstate(over="ignore"):
        p = np.exp2(logits, out=logits)
        total = p @ ones
    if not (np.isfinite(total).all() and total.all()):
        logits = h @ weight
        logits -= logits.max(axis=1, keepdims=True)
        own = np.take(logits, place)
        p = np.exp2(logits, out=logits)
        total = p @ ones
    own *= np.asarray(math.log(2), own.dtype)
    own -= np.log(total)
    return p, total, own


def _parts(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose product with a matrix of so many columns and WIDTH + 1 rows is a small one."""
    step = max(1, SMALL // ((WIDTH + 1) * width))
    return (slice(lo, min(lo + step, rows)) for lo in range(0, rows, step))


@dataclass
class Model:
    """values: the trained arrays by name; the last rows of "class" and "unit" are biases."""

    values: dict[str, np.ndarray]
    edges: np.ndarray

    SHAPES = {
        "now": (UNITS, WIDTH), "before": (UNITS, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, KEY), "key": (WIDTH, KEY), "value": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "down": (HIDDEN, WIDTH),
        "class": (WIDTH + 1, CLASSES), "unit": (WIDTH + 1, UNITS),
    }

    @classmethod
    def fresh(cls, words: Vocabulary, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        scale = {"now": 0.3, "before": 0.1, "place": 0.0, "value": 0.1, "down": 0.1, "class": 0.02, "unit": 0.02}
        values = {k: (rng.standard_normal(s) * scale.get(k, 1 / math.sqrt(s[0]))).astype(np.float32) for k, s in cls.SHAPES.items()}
        values["class"][WIDTH], values["unit"][WIDTH] = words.share, words.start
        return cls(values, words.edges)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.values[k].ravel() for k in self.SHAPES])

    def with_flat(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k, s in self.SHAPES.items():
            n = math.prod(s)
            out[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
        return Model(out, self.edges)

    @cached_property
    def classes(self) -> np.ndarray:
        """By unit: its class."""
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    def _projection(self) -> np.ndarray:
        """What makes queries (scaled), keys and values of a state, side by side."""
        v = self.values
        return np.concatenate([v["query"] * np.asarray(1 / math.sqrt(KEY), v["query"].dtype), v["key"], v["value"]], axis=1)

    def hidden(self, now: np.ndarray, before: np.ndarray, only: np.ndarray | None = None) -> tuple:
        """States after the block, (windows * WINDOW, WIDTH), for units and those before them (windows, WINDOW); and what the way back needs. only: the places whose states are asked for."""
        v = self.values
        n, t = now.shape
        h0 = np.take(v["now"], now.ravel(), axis=0)
        h0 += np.take(v["before"], before.ravel(), axis=0)
        h0.reshape(n, t * WIDTH)[:] += v["place"][:t].ravel()
        qkv = h0 @ self._projection()
        q, k, val = (x.reshape(n, t, -1) for x in (qkv[:, :KEY], qkv[:, KEY : 2 * KEY], qkv[:, 2 * KEY :]))
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.minimum(a, _LIMIT[:t, :t].astype(a.dtype, copy=False), out=a)  # the mask, and no overflow
        np.exp(a, out=a)
        total = (a @ np.ones((t, 1), a.dtype)).reshape(n * t, 1)
        o = (a @ val).reshape(n * t, WIDTH)
        o /= total
        h1 = h0 + o
        if only is not None:
            h1 = np.compress(only.ravel(), h1, axis=0)
        up = h1 @ v["up"]
        np.maximum(up, 0, out=up)
        h = up @ v["down"]
        h += h1
        return h, (h0, q, k, val, a, total, o, h1, up)

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The places whose target is in a class of several units, class by class; and each class's first and last unit and its slice of these places."""
        several = np.diff(self.edges) > 1
        at = np.flatnonzero(several[cls])
        at = at[np.argsort(cls[at].astype(np.uint8), kind="stable")]
        cuts = np.searchsorted(cls[at], np.arange(len(self.edges)))
        return at, [(int(self.edges[c]), int(self.edges[c + 1]), int(cuts[c]), int(cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts))]

    def log_probability(self, now: np.ndarray, before: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural logs of P(target unit) at the places that are scored, in order."""
        v, y = self.values, target[scored]
        cls = np.take(self.classes, y)
        states = np.ones((len(y), WIDTH + 1), v["now"].dtype)
        out, done = np.empty(len(y), states.dtype), 0
        for lo in range(0, len(now), AT_ONCE):
            h = self.hidden(now[lo : lo + AT_ONCE], before[lo : lo + AT_ONCE], scored[lo : lo + AT_ONCE])[0]
            states[done : done + len(h), :WIDTH], done = h, done + len(h)
        for s in _parts(len(y), CLASSES):
            out[s] = _softmax(states[s], v["class"], cls[s])[2]
        at, found = self._by_class(cls)
        some, own, inside = np.take(states, at, axis=0), np.take(y, at).astype(np.intp), np.empty(len(at), states.dtype)
        for first, last, lo, hi in found:
            weight = v["unit"][:, first:last]
            for s in _parts(hi - lo, last - first):
                s = slice(lo + s.start, lo + s.stop)
                inside[s] = _softmax(some[s], weight, own[s] - first)[2]
        out[at] += inside
        return out

    def gradient(self, now: np.ndarray, before: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the scored places, and the gradient by hand."""
        v, t = self.values, now.shape[1]
        g = {k: np.zeros_like(a) for k, a in v.items() if k not in ("now", "before")}
        hs, y, use = np.ones((now.size, WIDTH + 1), v["now"].dtype), target.ravel().astype(np.intp), scored.ravel()
        parts = [(lo, min(lo + AT_ONCE, len(now))) for lo in range(0, len(now), AT_ONCE)]
        kept = []
        for lo, hi in parts:
            hs[lo * t : hi * t, :WIDTH], saved = self.hidden(now[lo:hi], before[lo:hi])
            kept.append(saved)
        share = np.asarray(1 / max(np.count_nonzero(use), 1), hs.dtype)
        cls = np.where(use, np.take(self.classes, y), 0)  # class 0 has one unit
        weights = use * share
        dh, loss = np.empty((len(hs), WIDTH), hs.dtype), 0.0
        back = np.ascontiguousarray(v["class"][:WIDTH].T)
        # The rows of p are not divided by their sums: what they are multiplied with is.
        for s in _parts(len(hs), CLASSES):
            some = hs[s]
            p, total, own = _softmax(some, v["class"], cls[s])
            loss -= float(own @ weights[s])
            p.reshape(-1)[np.arange(0, p.size, CLASSES) + cls[s]] -= total
            scale = (weights[s] / total)[:, None]
            g["class"] += (some * scale).T @ p
            np.multiply(p @ back, scale, out=dh[s])
        at, found = self._by_class(cls)
        few, own_unit, scale, part = np.take(hs, at, axis=0), np.take(y, at), np.empty((len(at), 1), hs.dtype), np.empty((len(at), WIDTH), hs.dtype)
        for first, last, lo, hi in found:
            weight, some, mine = v["unit"][:, first:last], few[lo:hi], own_unit[lo:hi] - first
            p, total, own = _softmax(some, weight, mine)
            loss -= float(own.sum() * share)
            p.reshape(-1)[np.arange(0, p.size, last - first) + mine] -= total
            scale[lo:hi, 0] = share / total
            some *= scale[lo:hi]
            np.matmul(some.T, p, out=g["unit"][:, first:last])
            np.matmul(p, weight[:WIDTH].T, out=part[lo:hi])
        part *= scale
        dh[at] += part
        for (lo, hi), saved in zip(parts, kept):
            self._back(saved, dh[lo * t : hi * t], t, g)
        columns = np.ascontiguousarray(dh.T, float).T
        g["now"], g["before"] = (_summed(x.ravel(), columns).astype(dh.dtype) for x in (now, before))
        return loss, g

    def _back(self, saved: tuple, dh: np.ndarray, t: int, g: dict[str, np.ndarray]) -> None:
        """Adds to g what the block's parameters get from dh, which becomes the gradient of the block's inputs."""
        v, (h0, q, k, val, a, total, o, h1, up) = self.values, saved
        n = len(dh) // t
        g["down"] += up.T @ dh
        dup = dh @ np.ascontiguousarray(v["down"].T)
        dup *= up > 0
        g["up"] += h1.T @ dup
        dh += dup @ np.ascontiguousarray(v["up"].T)
        # a holds exponentials: what they meet is divided by their sums. The last column takes off the sum of da * a over the keys.
        do = np.empty((n * t, WIDTH + 1), dh.dtype)
        np.divide(dh, total, out=do[:, :WIDTH])
        np.negative(np.einsum("nw,nw->n", do[:, :WIDTH], o), out=do[:, WIDTH])
        do = do.reshape(n, t, WIDTH + 1)
        values = np.ones((n, WIDTH + 1, t), dh.dtype)
        values[:, :WIDTH] = val.transpose(0, 2, 1)
        da = do @ values
        da *= a
        back = np.empty((n, t, 2 * KEY + WIDTH), dh.dtype)
        np.matmul(da, k, out=back[..., :KEY])
        np.matmul(da.transpose(0, 2, 1), q, out=back[..., KEY : 2 * KEY])
        np.matmul(a.transpose(0, 2, 1), do[..., :WIDTH], out=back[..., 2 * KEY :])
        back = back.reshape(n * t, -1)
        mine = h0.T @ back
        g["query"] += mine[:, :KEY] * np.asarray(1 / math.sqrt(KEY), dh.dtype)
        g["key"] += mine[:, KEY : 2 * KEY]
        g["value"] += mine[:, 2 * KEY :]
        dh += back @ np.ascontiguousarray(self._projection().T)
        g["place"][:t] += dh.reshape(n, t * WIDTH).sum(axis=0).reshape(t, WIDTH)


def _summed(units: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each unit, column by column."""
    place, out = units.astype(np.intp), np.empty((UNITS, rows.shape[1]), rows.dtype)
    for i, column in enumerate(np.ascontiguousarray(rows.T, float)):
        out[:, i] = np.bincount(place, column, UNITS)
    return out


class Trainer:
    """Adam; its moments go on from one call to the next."""

    def __init__(self, model: Model, rate: float) -> None:
        self.model, self.rate, self.step = Model({k: a.copy() for k, a in model.values.items()}, model.edges), rate, 0
        self.first, self.second = ({k: np.zeros_like(a) for k, a in self.model.values.items()} for _ in range(2))

    def learn(self, windows: tuple[np.ndarray, ...], rng: np.random.Generator, batch: int = BATCH, steps: int = 0) -> None:
        """One pass over shuffled windows; with steps (all that there will be) the rate falls to a twentieth."""
        order = rng.permutation(len(windows[0]))
        for lo in range(0, len(order), batch):
            some, self.step = order[lo : lo + batch], self.step + 1
            _, g = self.model.gradient(*(w[some] for w in windows))
            now = self.rate * (1 - 0.95 * self.step / steps if steps else 1) / (1 - 0.9**self.step)
            for first, second, value, d in self._stretches(g):
                first *= np.float32(0.9)
                second *= np.float32(0.99)
                first += d * np.float32(0.1)
                d *= d
                d *= np.float32(0.01)
                second += d
                np.multiply(second, np.float32(1 / (1 - 0.99**self.step)), out=d)
                np.sqrt(d, out=d)
                d += np.float32(1e-8)
                np.divide(first, d, out=d)
                d *= np.float32(now)
                value -= d

    def _stretches(self, g: dict[str, np.ndarray]) -> Iterator[list[np.ndarray]]:
        """Moments, values and gradient, so many numbers at a time as stay in a core's cache."""
        for k, d in g.items():
            arrays = [x.reshape(-1) for x in (self.first[k], self.second[k], self.model.values[k], d)]
            for lo in range(0, d.size, STRETCH):
                yield [x[lo : lo + STRETCH] for x in arrays]


# ---- Windows


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many units, one after the other: each window's first place, the places that exist in it, and those that it scores."""
    first, last, follows = _cut(lengths, WINDOW - OVERLAP)
    place = first[:, None] + np.arange(WINDOW)
    here = place < last[:, None]
    return place, here, here & (~follows[:, None] | (np.arange(WINDOW) >= OVERLAP))


def _cut(lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows that begin every `step` places of their text: the first place, the end of the text, whether another one comes before."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ends = np.cumsum(lengths)
    return np.repeat(ends - lengths, count) + number * step, np.repeat(ends, count), number > 0


def inputs(target: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of units, one after the other: the unit before each, and the one before that. END stands before a text."""
    now, before = np.concatenate([[end], target[:-1]]), np.concatenate([[end, end], target[:-2]])[: len(target)]
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    now[first] = before[first] = end
    before[np.minimum(first + 1, len(target) - 1)[lengths[lengths > 0] > 1]] = end
    return now, before


def training_windows(target: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """now, before, target and which places count: each unit is the target of one window, one after the other."""
    now, before = inputs(target, lengths, end)
    first, last, _ = _cut(lengths, WINDOW)
    place = first[:, None] + np.arange(WINDOW)
    here = place < last[:, None]
    place = np.minimum(place, len(target) - 1)
    return tuple(x[place].astype(np.uint16) for x in (now, before, target)) + (here,)


# ---- What is shared with the tasks


@dataclass
class Scorer:
    words: Vocabulary
    model: Model

    def score(self, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, for texts of pieces (END included), one after the other."""
        target = self.words.unit[pieces]
        now, before = inputs(target, lengths, self.words.end)
        out = np.add.reduceat(self.words.tail[pieces], np.cumsum(lengths) - lengths)
        text = np.repeat(np.arange(len(lengths)), lengths)
        first, last, follows = _cut(lengths, WINDOW - OVERLAP)
        for lo in range(0, len(first), BLOCK):
            place = first[lo : lo + BLOCK, None] + np.arange(WINDOW)
            use = place < last[lo : lo + BLOCK, None]
            use[:, :OVERLAP] &= ~follows[lo : lo + BLOCK, None]
            np.minimum(place, len(target) - 1, out=place)
            found = self.model.log_probability(now[place], before[place], target[place], use)
            out += np.bincount(text[place[use]], found, len(lengths))
        return out / math.log(10)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    size = 0

    def out() -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    for batch in batches:
        for lo, hi in lots(batch.column(0), LOT):
            held.append(words_of(batch.column(0).slice(lo, hi - lo))[0])
            size += held[-1].nbytes
            if size > COUNTED:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n over the texts of docs."""
    return docs.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(words: pa.Array) -> np.ndarray:
    """The ids of an array of bytes, one after the other."""
    if not len(words):
        return np.zeros(0, np.uint16)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(np.uint16) if data else np.zeros(0, np.uint16)


def _spelled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(before, id, n): the pieces of words, n times each; before is the piece before it in the word, or -1."""
    _, size = speller(path)
    for batch in batches:
        words = spelled_array(batch.column(0), path)
        lengths = pc.binary_length(words).to_numpy().astype(np.int64) // 2
        n, ids = np.repeat(batch.column(1).to_numpy(), lengths), _ids(words).astype(np.int64)
        before = np.concatenate([[-1], ids[:-1]])[: len(ids)]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
        key, place = np.unique((before + 1) * size + ids, return_inverse=True)
        total = np.bincount(place, n, len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key // size - 1, pa.int64()), pa.array(key % size, pa.int64()), pa.array(total, pa.float64())], ["before", "id", "n"])


def units_of(counts: DataFrame, ends: int, path: str) -> Vocabulary:
    """The vocabulary, from the counts of all distinct training words, each spelled once."""
    _, size = speller(path)
    pairs = materialise(counts.mapInArrow(lambda b: _spelled(b, path), "before long, id long, n double").groupBy("before", "id").agg(F.sum("n").alias("n")), "pairs")
    single = pairs.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece at most
    number = np.zeros(size + 1)
    number[single.column("id").to_numpy()] = single.column("n").to_numpy()
    number[size] = ends
    order = ranked(number)
    behind = [-1, *(int(p) for p in order[: SINGLE - 1])]
    met = pairs.where(F.col("before").isin(behind)).toArrow()  # SINGLE rows for each piece at most
    rank, column = np.full(size + 1, -1), np.full(size + 2, -1)
    rank[order], column[np.array(behind) + 1] = np.arange(len(order)), np.arange(SINGLE)
    row, col = rank[met.column("id").to_numpy()], column[met.column("before").to_numpy() + 1]
    near = np.zeros((len(order), SINGLE))
    np.add.at(near, (row[row >= 0], col[row >= 0]), met.column("n").to_numpy()[row >= 0])
    return vocabulary(number, near)


@dataclass
class Encoder:
    """Spells texts and adds up the baseline over frequent words."""

    path: str
    words: pa.Array  # frequent words
    terms: np.ndarray  # log10 of the smoothed share of each
    end: float  # the same for END
    ends: int

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, learn, where learn may be missing -> what ENCODED names."""
        for batch in batches:
            for lo, hi in lots(batch.column(1), LOT):
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *self._of(some.column(1))], ["doc_id", "learn", "n_tokens", "pieces", "base", "known", "rare"])

    def _of(self, texts: pa.Array) -> list[pa.Array]:
        _, size = speller(self.path)
        words, count = words_of(texts)
        coded = words.dictionary_encode()
        distinct, place = coded.dictionary, coded.indices.to_numpy()
        found = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy()
        term = np.append(self.terms, 0.0)[found][place]
        row = np.repeat(np.arange(len(texts)), count)
        base = np.bincount(row, term, len(texts)) + self.end
        rare = (found < 0)[place]
        many = np.bincount(row, rare, len(texts)).astype(np.int64)
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), distinct.take(pa.array(place[rare])))
        # END is one more word, behind each text.
        spelling = pa.concat_arrays([spelled_array(distinct, self.path), pa.array([np.array([size], np.uint16).tobytes()], pa.binary())])
        ends = np.cumsum(count)
        taken = spelling.take(pa.array(np.insert(place, ends, len(distinct))))
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy().astype(np.int64) // 2)])
        pieces = _binary(edges[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])], _ids(taken))
        return [pa.array(count + 1), pieces, pa.array(base), pa.array(count - many + (self.ends > 0)), others]


ENCODED = "doc_id long, learn boolean, n_tokens long, pieces binary, base double, known long, rare array<binary>"


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row of some rows, their texts' pieces one after the other, and how many each has."""
    for lo, hi in lots(column, 400_000):
        some = column.slice(lo, hi - lo).cast(pa.binary())
        yield lo, hi, _ids(some), pc.binary_length(some).to_numpy().astype(np.int64) // 2


def _some_windows(batches: Iterator[pa.RecordBatch], words: Vocabulary, share: float) -> Iterator[pa.RecordBatch]:
    """Each training window with this probability, by a hash of its text."""
    for batch in batches:
        for _, _, pieces, lengths in _texts(batch.column(0)):
            parts = training_windows(words.unit[pieces], lengths, words.end)
            rng = np.random.default_rng(xxhash.xxh3_64_intdigest(pieces.tobytes()))
            picked = rng.random(len(parts[0])) < share
            if picked.any():
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.stack(parts, axis=1)[picked].astype(np.uint16)], pa.binary())], ["window"])


def started(texts: DataFrame, words: Vocabulary, seed: int = 3) -> Model:
    """The model after training on about WARM windows of texts(pieces)."""
    model = Model.fresh(words)
    total = texts.agg(F.sum(F.ceil(F.length("pieces") / (2 * WINDOW)))).first()[0] or 0
    if not total:
        return model
    few = sorted(texts.mapInArrow(lambda b: _some_windows(b, words, WARM / total), "window binary").toArrow().column(0).to_pylist())
    if not few:
        return model
    table = np.frombuffer(b"".join(few), np.uint16).reshape(len(few), 4, WINDOW)
    parts, rng = (table[:, 0], table[:, 1], table[:, 2], table[:, 3] > 0), np.random.default_rng(seed)
    batches = -(-len(few) // WARM_BATCH)
    rounds = max(1, min(20, -(-WARM_STEPS // batches)))
    trainer = Trainer(model, 0.01)
    for _ in range(rounds):
        trainer.learn(parts, rng, WARM_BATCH, rounds * batches)
    return trainer.model


def _trained(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer: Scorer = shared.value
    trainer, seen, held, n = Trainer(scorer.model, 0.003), 0, [], 0
    rng = np.random.default_rng(5)

    def learn() -> None:
        nonlocal seen, n
        parts = tuple(map(np.concatenate, zip(*held)))
        trainer.learn(parts, rng)
        seen += int(parts[3].sum())
        held.clear()
        n = 0

    for batch in batches:
        for _, _, pieces, lengths in _texts(batch.column(0)):
            held.append(training_windows(scorer.words.unit[pieces], lengths, scorer.words.end))
            n += len(held[-1][0])
            if n >= HELD:
                learn()
    if n:
        learn()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([trainer.model.flat().tolist()], pa.list_(pa.float32()))], ["seen", "flat"])


def averaged(texts: DataFrame, scorer: Scorer) -> Model:
    """The mean of what the partitions of all texts(pieces) make of the model. Parameters are averaged by Spark, place by place; as many rows as the model has numbers come back."""
    shared = texts.sparkSession.sparkContext.broadcast(scorer)
    parts = texts.mapInArrow(lambda b: _trained(b, shared), "seen long, flat array<float>")
    mean = parts.select("seen", F.posexplode("flat")).groupBy("pos").agg((F.sum(F.col("col").cast("double") * F.col("seen")) / F.sum("seen")).alias("v"))
    table = mean.toArrow()
    if not table.num_rows:
        return scorer.model
    flat = np.zeros(table.num_rows, np.float32)
    flat[table.column("pos").to_numpy()] = table.column("v").to_numpy()
    return scorer.model.with_flat(flat)


def learned(texts: DataFrame, counts: DataFrame, ends: int, path: str) -> Scorer:
    """The trained model. texts(pieces): the training texts as pieces; counts: their word_counts."""
    words = units_of(counts, ends, path)
    scorer = Scorer(words, started(texts, words))
    return Scorer(words, averaged(texts, scorer))


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, pieces, lengths in _texts(batch.column(0)):
            score = pa.array(shared.value.score(pieces, lengths), pa.float64())
            yield pa.RecordBatch.from_arrays([score, *batch.slice(lo, hi - lo).columns[1:]], ["score", *batch.schema.names[1:]])


def scores(docs: DataFrame, learn: Column, pieces: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs; learn: of which rows to learn (null: not).

    A null text counts as empty and is END alone; repeated rows give repeated rows and count as often; without
    rows to learn from every count is 0 and the model is as it starts; an empty table gives none. Of docs only doc_id,
    text and what `learn` needs are read. pieces: a file of ranks of a byte-level BPE with fewer than 65,535 pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = materialise(word_counts(rows.where("learn")), "words")
    ends = rows.where("learn").count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = int(total) + ends, int(distinct) + (ends > 0)
    under = math.log10(tokens + 0.5 * (distinct + 1))
    top = counts.where((F.col("n") >= threshold(counts, hot)) & (F.length("word") <= LONGEST)).toArrow()
    words, terms = pa.array(top.column("word").to_pylist(), pa.binary()), np.log10(top.column("n").to_numpy() + 0.5) - under
    encoder = spark.sparkContext.broadcast(Encoder(pieces, words, terms, math.log10(ends + 0.5) - under, ends))
    del top, words, terms
    encoded = materialise(rows.mapInArrow(lambda b: encoder.value.rows(b), ENCODED), "pieces")
    encoder.destroy()
    shared = spark.sparkContext.broadcast(learned(encoded.where("learn").select("pieces"), counts, ends, pieces))
    columns = "score double, doc_id long, n_tokens long, base double, known long, rare array<binary>"
    scored = encoded.select("pieces", "doc_id", "n_tokens", "base", "known", "rare").mapInArrow(lambda b: _scored(b, shared), columns)
    # One row for each rare word; the first carries what is known of the text.
    spread = scored.withColumn("row", F.monotonically_increasing_id()).select("row", F.struct("doc_id", "n_tokens", "score", "base", "known").alias("head"), F.posexplode_outer("rare").alias("at", "word"))
    spread = spread.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("head")).alias("head"), "word")
    term = F.when(F.col("word").isNotNull(), F.log10(F.coalesce("n", F.lit(0)) + 0.5) - under).otherwise(0.0)
    found = spread.join(counts, "word", "left").groupBy("row").agg(F.max("head").alias("head"), F.sum(term).alias("rest"), F.count("n").alias("more"))
    return found.select("head.doc_id", "head.n_tokens", (F.col("head.known") + F.col("more")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("head.base") + F.col("rest")).alias("base_score"), "head.score")
