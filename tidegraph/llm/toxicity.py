"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct hashed words, word pairs and pairs with one word between them. Training takes
the labelled rows with the smallest hashes of their ids, at most `sample_rows` of them and `sample_bytes` of their
features (documented bounds, so the one task that learns holds a bounded input); per-coordinate learning rates and L1 leave few weights other than
zero. The model is at most 2^bits weights, so its size is bounded whatever the data, and it is sent to all tasks.
Scoring is one pass over all texts without a shuffle.

Defined results: a null or empty text has no features and scores the bias alone. Labels other than 0 and 1, or
null, are not learned from; of a doc_id labelled more than once, 1 wins, and of rows with equal ids one is learned
from, that with the smallest feature bytes. With no usable labels every score is 0.5.
Repeated rows are scored once each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import byte_words, free_name, in_workers, stored, text_batches, text_of, work_dir

BITS = 20
SAMPLE_ROWS = 20_000
#: Bytes of features that the learning task holds.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Weights other than zero by feature, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.features] = self.weights
        return w


def word_hashes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of each word; as quick as a memo of words, and holds none of them."""
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed words, neighbours and pairs around one word, in order, repeats included."""
    h = word_hashes(byte_words(text.lower()))
    spread, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    pair = lambda a, b, kind: (a * np.uint64(0xC2B2AE3D27D4EB4F) + b + np.uint64(kind)) * spread >> down
    return np.concatenate([h * spread >> down, pair(h[:-1], h[1:], 1), pair(h[:-2], h[2:], 2)]).astype(np.int64)


def value(n: int) -> float:
    """The value of a text's features, by their number: long texts hold more of everything."""
    return 1.0 / max(1.0, n) ** 0.25


def logit(x: np.ndarray, dense: np.ndarray, bias: float) -> float:
    """x: features of a text, repeats included; each counts once."""
    w = dense[x]
    some = np.unique(x[w != 0])
    return float(value(len(x)) * dense[some].sum() + bias)


def ftrl(rows: list[tuple[np.ndarray, int, int]], bits: int = BITS, alpha: float = 3.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.0, epochs: int = 4) -> Model:
    """One pass after another over (distinct features, number of features, label), in the given order."""
    z, n, zb, nb = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    ones = sum(y for *_, y in rows)
    heavy = max(1.0, (len(rows) - ones) / max(1, ones))  # the rarer class counts more
    for _ in range(epochs):
        for x, size, y in rows:
            v, zi, ni = value(size), z[x], n[x]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(v * w.sum() + wb, -35, 35)))
            g = (p - y) * (heavy if y else 1.0)
            gi = g * v
            z[x] = zi + gi - (np.sqrt(ni + gi * gi) - root) / alpha * w
            n[x] = ni + gi * gi
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], float(-zb / ((beta + nb**0.5) / alpha)), bits)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from rows that are not held out: of each id that was chosen its smallest text, `sample_bytes` in all."""
    spark = docs.sparkSession
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"))
    chosen = stored(usable.select("doc_id", "toxic", order.alias("place")).orderBy("place", "doc_id").limit(sample_rows), work_dir(spark, "toxicity-sample"))
    texts = docs.select(F.col("doc_id"), text_of(docs).alias("text"))
    # at most sample_rows narrow rows: a bounded table
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "place", "toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(x := features(t.as_py(), bits)).astype("<i4").tobytes() + len(x).to_bytes(8, "little") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), b.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "place", "toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for b in batches:  # in order of place, so that the bound keeps the same rows however they are dealt
            for y, x in zip(b.column("toxic"), b.column("x"), strict=True):
                x = x.as_py()
                total += len(x)
                if total <= sample_bytes:
                    rows.append((np.frombuffer(x[:-8], "<i4"), int.from_bytes(x[-8:], "little"), y.as_py()))
        model = ftrl(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.features.astype("<i4").tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["features", "weights", "bias"])

    schema = chosen.select("doc_id", "place", "toxic").schema.add("x", "binary")
    with text_batches(spark):
        extracted = stored(in_workers(sample, extract, schema), work_dir(spark, "toxicity-features"))
        # an id that stands more than once gives one row
        once = extracted.groupBy("doc_id", "place", "toxic").agg(F.min("x").alias("x")).select("place", "toxic", "x")
        # the model is learned in one task: at most sample_rows rows, and it holds sample_bytes of them
        learned = in_workers(once.coalesce(1).sortWithinPartitions("place", "x"), learn, "features binary, weights binary, bias double").collect()
    if not learned:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)
    return Model(np.frombuffer(learned[0].features, "<i4").astype(np.int64), np.frombuffer(learned[0].weights, np.float64), learned[0].bias, bits)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns of `keep`, and the score, called `name`; written."""
    spark = docs.sparkSession
    text = free_name(docs, "text_")
    given = docs.select(*keep, text_of(docs).alias(text))
    sent = spark.sparkContext.broadcast((model.features, model.weights, model.bias, model.bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w, bias, bits = sent.value
        dense = Model(f, w, bias, bits).dense()
        for b in batches:
            scores = [1 / (1 + np.exp(-np.clip(logit(features(t.as_py(), bits), dense, bias), -35, 35))) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    with text_batches(spark):
        return stored(in_workers(given, work, given.select(*keep).schema.add(name, "double")), work_dir(spark, "toxicity-scores"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored at the threshold or above."""
    columns, own = docs.columns, free_name(docs, "score_")
    scored = score(docs, train(docs, labels), tuple(columns), own)
    return scored.where(F.col(own) < threshold).select(*columns)
