"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or nothing. Expectation-
maximisation over the vote patterns (a row per pattern, so a few thousand at
most, with counts over all documents) estimates how often each labeller votes
what under either class, and with that the posterior of every pattern. The
posteriors of a bounded sample of documents train a hashed linear scorer, which
then scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches, utf8
from .common import stage
from .quality_rules import STOP_WORDS

#: Documents in the training sample at most: those with the smallest hash of their id.
SAMPLE = 8000
#: Hashed word features; the classes' pairs and the share of repeats follow.
BUCKETS = 1 << 18
_CLASSES = 8
_SHARES = 11
DIMENSIONS = BUCKETS + _CLASSES * _CLASSES + _SHARES
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2

_STOPS = frozenset(w.encode() for w in STOP_WORDS)


def _class_table() -> np.ndarray:
    """Lower-case letter, upper-case letter, digit, space, line end, sentence mark, symbol, beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-")):
        out[list(chars)] = k
    out[128:] = 7
    return out


_CLASS = _class_table()


@dataclass(frozen=True)
class Shape:
    """What the labellers see of a text."""

    words: int
    symbols: float
    repeats: float
    same_lines: float
    stops: float
    capitals: float
    distinct: float
    pairs: np.ndarray


def shape(text: bytes, words: list[bytes]) -> Shape:
    n = len(words)
    classes = _CLASS[np.frombuffer(text, np.uint8)]
    seen = np.bincount(classes, minlength=_CLASSES)
    pairs = np.bincount(classes[:-1] * np.uint8(_CLASSES) + classes[1:], minlength=_CLASSES**2) if len(text) > 1 else np.zeros(_CLASSES**2, np.int64)
    grams = set(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    some = max(1, n)
    return Shape(n, int(seen[6]) / some, 1 - len(grams) / (n - 2) if n > 2 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), sum(map(_STOPS.__contains__, words)) / some, int(seen[1]) / max(1, int(seen[0] + seen[1])), len(set(words)) / some, pairs)


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Each labeller votes from the shape alone and abstains in between.
LABELLERS = {
    "symbols": lambda s: _vote(s.symbols, s.symbols < 0.05, s.symbols > 0.25),
    "repeats": lambda s: NONE if s.words < 20 else _vote(s.repeats, s.repeats < 0.08, s.repeats > 0.25),
    "same_lines": lambda s: _vote(s.same_lines, s.same_lines == 0 and s.words >= 50, s.same_lines > 0.4),
    "stops": lambda s: NONE if s.words < 12 else _vote(s.stops, s.stops > 0.06, s.stops < 0.01),
    "capitals": lambda s: NONE if s.words < 12 else _vote(s.capitals, s.capitals < 0.12, s.capitals > 0.3),
    "distinct": lambda s: NONE if s.words < 80 else _vote(s.distinct, s.distinct > 0.4, s.distinct < 0.2),
    "words": lambda s: NONE if s.words else BAD,
}


def pattern(s: Shape) -> int:
    """The votes in base three, the first labeller last."""
    out = 0
    for vote in reversed(LABELLERS.values()):
        out = out * 3 + vote(s)
    return out


def features(words: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values, of length 1 together."""
    hashed, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1), return_counts=True)
    at = np.flatnonzero(s.pairs)
    word_values = np.log1p(counts)
    share = min(_SHARES - 1, int(s.repeats * (_SHARES - 1) + 0.5))
    parts = [word_values / max(1e-9, np.linalg.norm(word_values)), np.sqrt(s.pairs[at] / max(1, s.pairs.sum())), np.ones(1)]
    return np.concatenate([hashed.astype(np.int64), BUCKETS + at, [BUCKETS + _CLASSES**2 + share]]), np.concatenate(parts) / np.sqrt(3)


def estimate(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], dict[str, float]]:
    """Posterior of good for each pattern, and each labeller's estimated accuracy where it votes.

    Labellers seek different defects, so most votes on a bad document may be
    good: what is estimated is each labeller's rate of bad votes in either
    class. An abstention tells nothing. The first guess takes any bad vote for
    a defect, which settles which class is which; rates stay on its side of
    each other.
    """
    names = list(LABELLERS)
    keys = sorted(counts)
    votes = np.array([[k // 3**i % 3 for i in range(len(names))] for k in keys], np.int64).reshape(len(keys), len(names))
    weight = np.array([counts[k] for k in keys], float)
    bad, voted = votes == BAD, votes != NONE
    good = np.where(bad.any(1), 0.1, 0.95)
    for _ in range(rounds if keys else 0):
        prior = np.clip((weight * good).sum() / weight.sum(), 0.02, 0.98)
        rate = [((weight * share) @ bad + 1 * first) / ((weight * share) @ voted + 1) for share, first in ((1 - good, 0.5), (good, 0.05))]
        rate[0] = np.clip(np.maximum(rate[0], 1.5 * rate[1]), 1e-3, 0.999)
        rate[1] = np.clip(rate[1], 1e-4, 0.6)
        log = [np.log(p) + (np.where(bad, np.log(r), np.log1p(-r)) * voted).sum(1) for r, p in zip(rate, (1 - prior, prior))]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    accuracy = {}
    for i, name in enumerate(names):
        right = (weight * np.where(votes[:, i] == GOOD, good, np.where(bad[:, i], 1 - good, 0))).sum()
        accuracy[name] = float(right / max(1e-9, (weight * voted[:, i]).sum()))
    return dict(zip(keys, good.tolist())), accuracy


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on soft labels (the last is the bias), by AdaGrad in a fixed order."""
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-2)
    for _ in range(epochs):
        for at, value, label in rows:
            error = label - 1 / (1 + np.exp(-(w[at] @ value + w[-1])))
            for i, step in ((at, error * value), (DIMENSIONS, error)):
                seen[i] += step * step
                w[i] += rate * step / np.sqrt(seen[i])
    return w


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, weak_label, score, kept) per row.

    weak_label: the posterior that the document is good, from the votes alone;
    score: the trained scorer's probability; kept: score of at least
    `threshold`. Null texts count as empty and are scored like others; repeated
    rows get equal scores; a table without rows gives none. The same table
    gives the same scores: the sample goes by hash of doc_id and text.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("draw", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "draw": b.column("draw"), "pattern": [pattern(shape(t, t.split())) for t in utf8(b, "text")]}

    voted = stage(map_batches(rows, vote, T.StructType([T.StructField("doc_id", id_type), T.StructField("draw", T.LongType()), T.StructField("pattern", T.IntegerType())])), "votes")
    good, _ = estimate({r[0]: r[1] for r in voted.groupBy("pattern").count().collect()})  # 3 ** labellers rows at most

    chosen = voted.orderBy("draw").limit(sample).select("draw").distinct()
    sent_good = spark.sparkContext.broadcast(good)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = []
            for t in utf8(b, "text"):
                s = shape(t, words := t.split())
                found.append((*features(words, s), sent_good.value[pattern(s)]))
            yield {"draw": b.column("draw"), "at": [f[0].astype(np.int32) for f in found], "value": [f[1].astype(np.float32) for f in found], "label": [f[2] for f in found]}

    described = T.StructType([T.StructField("draw", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("label", T.DoubleType())])
    picked = rows.join(F.broadcast(chosen), "draw", "left_semi").limit(sample)  # `sample` ids at most
    table = map_batches(picked, describe, described).toArrow().sort_by("draw")
    w = train([(np.asarray(a.values), np.asarray(v.values, float), y.as_py()) for a, v, y in zip(table["at"], table["value"], table["label"])])
    sent = spark.sparkContext.broadcast(w.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            labels, scores = [], []
            for t in utf8(b, "text"):
                s = shape(t, words := t.split())
                at, value = features(words, s)
                labels.append(sent_good.value[pattern(s)])
                scores.append(1 / (1 + np.exp(-float(sent.value[at] @ value + sent.value[-1]))))
            yield {"doc_id": b.column("doc_id"), "weak_label": labels, "score": scores}

    scored = map_batches(rows.drop("draw"), score, T.StructType([T.StructField("doc_id", id_type), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    return scored.withColumn("kept", F.col("score") >= threshold)
