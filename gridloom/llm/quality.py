"""Quality classifier: naive Bayes features for a support vector machine.

A text's features are n-gram indicators: byte trigrams, 5-grams of byte classes (letters, capitals, digits, white
space, each mark for itself) and how many of its 8-byte grams come again, each hashed to one of FEATURES places. Every
indicator is scaled by its class log-count ratio (naive Bayes), and a linear model with hinge loss is fitted on
the scaled indicators by dual coordinate descent. The margin of held-back sample rows sets the slope of the score
and puts the best cut at THRESHOLD.

The model is fitted on at most SAMPLE labelled rows a class (documented bound; the rows with the smallest
hashes of their ids); their hashed features, not their texts, come to the driver. Scoring is one scan of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 18
SAMPLE = 4_000  # labelled rows of each class that the model is fitted on, at most
THRESHOLD = 0.7
_K32, _SHIFT = np.uint32(0x9E3779B1), np.uint32(14)  # the product's upper 18 bits


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_CLASS = _classes()
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x80:0x9F] = True  # after 0xC3: capital letters of Latin-1


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text's indicators, sorted; never none. The empty text has its own, place 0; a text of one or two bytes has one for each byte and one for both."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(1, np.int64)
    seen = np.zeros(FEATURES, bool)
    kinds = _CLASS[raw]
    if raw.max() >= 0xC3:
        kinds[1:][(raw[:-1] == 0xC3) & _CAPITAL[raw[1:]]] = ord("A")
    one = raw.astype(np.uint32)
    two = one[:-1] << 8 | one[1:]
    if len(raw) < 3:
        seen[((one + 1 << 24) * _K32) >> _SHIFT] = True
        seen[((two | 1 << 31) * _K32) >> _SHIFT] = True
    else:
        seen[((two[:-1] << 8 | one[2:]) * _K32) >> _SHIFT] = True
    if len(raw) >= 5:
        kind = kinds.astype(np.uint32)
        pair = kind[:-1] * 257 + kind[1:]
        seen[((pair[:-3] * 66_049 + pair[2:-1]) * 257 + kind[4:] + 7) * _K32 >> _SHIFT] = True
    if len(raw) >= 64:
        # How large a share of the 8-grams comes again, in steps of a tenth; distinct ones by linear counting.
        four = two[:-2] * 65_537 + two[2:]
        eight = four[:-4] * _K32 + four[4:]
        met = np.zeros(FEATURES, bool)
        met[eight * _K32 >> _SHIFT] = True
        distinct = -FEATURES * np.log1p(-np.count_nonzero(met) / (FEATURES + 1))
        seen[8 + int(min(max(1 - distinct / len(eight), 0.0), 1.0) * 10)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weight: np.ndarray  # by place, log-count ratio included
    bias: float
    slope: float
    cut: float

    def score(self, places: np.ndarray) -> float:
        margin = float(self.weight[places].sum()) / float(np.sqrt(len(places))) + self.bias
        z = self.slope * (margin - self.cut) + float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes: log of the indicators' smoothed shares in class 1 over those in class 0."""
    share = []
    for label in (1, 0):
        some = [r for r, y in zip(rows, labels) if y == label]
        count = np.bincount(np.concatenate([np.empty(0, np.int64), *some]), minlength=FEATURES) + alpha
        share.append(count / (len(some) + 2 * alpha))
    return np.log(share[0] / share[1])


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss, by dual coordinate descent over shuffled rows."""
    y, w, b = np.where(labels == 1, 1.0, -1.0), np.zeros(FEATURES), 0.0
    dual, norm = np.zeros(len(rows)), np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                dual[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, seed: int = 7) -> Model:
    """Fit on four fifths, set slope and cut on the last fifth, then fit the weights on all rows."""
    if len(set(labels.tolist())) < 2:
        # One class alone (or no labels): every text gets that class, or 1.
        always = float(labels[0]) if len(labels) else 1.0
        return Model(np.zeros(FEATURES), 1.0 if always else -1.0, 3.0, 0.0)
    ratio = log_count_ratio(rows, labels)

    def weights(index: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in index]
        values = [r[x] / np.sqrt(len(x)) for x in some]
        share = np.bincount(labels[index], minlength=2) / len(index)
        w, b = coordinate_descent(some, values, labels[index], cost * 0.5 / share[labels[index]], seed=seed)
        return w * r, b

    order = np.random.default_rng(seed).permutation(len(rows))
    held, rest = order[: len(order) // 5], order[len(order) // 5 :]
    slope, cut = 3.0, 0.0
    if len(set(labels[rest].tolist())) == 2 and len(set(labels[held].tolist())) == 2:
        w, b = weights(rest, log_count_ratio([rows[i] for i in rest], labels[rest]))
        margin = np.array([w[rows[i]].sum() / np.sqrt(len(rows[i])) + b for i in held])
        slope, cut = calibrate(margin, labels[held])
    return Model(*weights(np.arange(len(rows)), ratio), slope, cut)


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The cut with the best balanced accuracy (the middle of the best stretch) and a slope that spreads the score over the margins around it."""
    order = np.argsort(margin)
    m, y = margin[order], labels[order]
    low = np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    high = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    best = np.flatnonzero(low + high >= (low + high).max() - 1e-12)
    ends = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    i, j = best[0], best[-1]
    cut = float((ends[i] + ends[i + 1]) / 2) if i == j else float((ends[i] + ends[j + 1]) / 2)
    return 3.0 / max(float(np.abs(m - cut).mean()), 1e-6), cut


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).astype(np.int32) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["places", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows of labels(doc_id, label): at most `sample` of each class, those with the smallest hashes of doc_id.

    Labels with a null or unknown doc_id, and labels that are neither 0 nor 1, are left out. Repeated labels or documents
    count as often as they stand there; one doc_id with both labels counts for both. A null text is the empty text. Where
    one class or both tables are empty, every text gets the class that there is, or 1.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    some = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))  # two times the bound of the sample
    found = docs.select("doc_id", "text").join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), "text").select("text", "label")
    table = found.mapInArrow(_places, "places array<int>, label int").toArrow()
    rows = [np.asarray(x, np.int64) for x in table.column("places").to_pylist()]
    return fit(rows, np.asarray(table.column("label").to_pylist(), np.int64))


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            some = batch.slice(lo, 1024)
            score = pa.array([model.value.score(features(t)) for t in some.column(some.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], score], [*some.schema.names[:-1], "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per document, 0 to 1. Null and empty texts score as the empty text does; repeated rows score alike; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scores(b, shared), "doc_id long, score double")


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects; columns as they were, whatever their names.

    A null or empty text is judged as the empty text is; repeated rows are judged alike; an empty table gives none.
    """
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"gridloom_{i}" for i in range(len(columns))]
    fields = docs.toDF(*names).withColumn("gridloom_text", F.col(names[columns.index("text")]))
    schema = fields.drop("gridloom_text").withColumn("score", F.lit(0.0)).schema
    return fields.mapInArrow(lambda b: _scores(b, shared), schema).where(predicted(F.col("score")) == 1).drop("score").toDF(*columns)
