"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word frequencies are counted over all documents, for the benchmark's vocabulary. From each word of a test item
starts one seed: the shortest n-gram, of two words or more and of any length, whose words would stand together by
chance with a probability of 2^-rare_bits or less. An item that has no such n-gram is seeded by single words, the
rarest half of them and one more: an alignment that scores half has one of these among its matches, so such an item is
never missed. Where a document holds a seed, the passage around it is aligned with the whole item by Smith-Waterman
over words; the score is the best local alignment divided by that of an exact copy, so edited and paraphrased copies
score in proportion to what they keep. A copy of an item with rare n-grams is missed only where edits break all of them.

Scale: two passes over the texts without a shuffle of any. The benchmark goes to the tasks only in blocks of bounded
size (block_chars, or one item that is longer); a larger benchmark is taken block by block against all documents. A
document is handled alone; hits of a passage copied into a third of all documents stay where the documents are.

Defined results: a null text is empty and matches nothing; items of equal words are aligned once and each is reported;
repeated rows of the benchmark (equal id and text) are one item; repeated documents match once each; with an empty
table on either side there are no matches. Of places with equal scores the first is reported. Only doc_id, text and
item_id, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import byte_words, free_name, in_workers, stored, text_batches, text_of, work_dir

RARE_BITS = 28.0
THRESHOLD = 0.5
MATCH, OTHER, GAP = 1.0, -0.5, -0.5
BLOCK_CHARS = 8_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def values_of(n: int) -> np.ndarray:
    """A 64-bit value for each word number."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ x >> np.uint64(32)


@dataclass
class Seeds:
    """The benchmark as the tasks need it."""

    words: dict[bytes, int]
    items: list[np.ndarray]  # word numbers, each once
    ids: list[list]  # of each item
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted hashes, item, place in the item


_BASE = 0xD6E8FEB86659FD93


class Grams:
    """Hashes of the n-grams of word numbers, for any n; a number below 0 is a word of no item."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        n = len(ids)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(ids < 0, 0, values[ids]) * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[places + n] - self.sums[places]) * self.down[places]


def make_seeds(items: list[tuple], bits: dict[bytes, float], rare_bits: float = RARE_BITS) -> Seeds:
    vocabulary = {w: k for k, w in enumerate(sorted(bits))}
    weight = np.array([bits[w] for w in sorted(bits)])
    values = values_of(max(1, len(vocabulary)))
    same: dict[tuple, list] = {}
    for i, text in items:
        same.setdefault(tuple(vocabulary[w] for w in byte_words(text or "")), []).append(i)
    numbers = [np.array(words, np.int64) for words in same]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, ids in enumerate(numbers):
        total = np.concatenate([[0.0], np.cumsum(weight[ids])]) if len(ids) else np.zeros(1)
        ends = np.maximum(np.searchsorted(total, total[:-1] + rare_bits - 1e-9), np.arange(len(ids)) + 2)
        chosen = [(int(a), int(ends[a] - a)) for a in np.flatnonzero(ends <= len(ids))]
        if not chosen:
            chosen = [(int(a), 1) for a in np.argsort(-weight[ids], kind="stable")[: len(ids) // 2 + 1]] if len(ids) else []
        grams = Grams(ids, values)
        for start, n in chosen:
            found.setdefault(n, []).append((int(grams.at(np.array([start]), n)[0]), k, start))
    by = {}
    for n, rows in found.items():
        rows.sort()
        by[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    return Seeds(vocabulary, numbers, list(same.values()), by)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment and where in the passage it ends."""
    best, at, steps = 0.0, 0, -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1)
    for word in item:
        new = np.maximum(row + GAP, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, OTHER))
        row = np.maximum.accumulate(new + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, at = float(row[k]), k
    return best, at


def matches(seeds: Seeds, values: np.ndarray, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the items that a text holds, the best place of each."""
    get = seeds.words.get
    ids = np.array([get(w, -1) for w in byte_words(text)], np.int64)
    if not len(ids):
        return []
    run, grams = np.concatenate([[0], np.cumsum(ids < 0)]), Grams(ids, values)
    hits: dict[int, list[int]] = {}
    for n, (hashes, items, places) in seeds.by_length.items():
        if len(ids) < n:
            continue
        known = np.flatnonzero(run[n:] == run[: len(run) - n])
        if not len(known):
            continue
        h = grams.at(known, n)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(high > low):
            for s in range(low[k], high[k]):
                hits.setdefault(int(items[s]), []).append(int(known[k] - places[s]))
    out = []
    for k, starts in hits.items():
        item, starts = seeds.items[k], sorted(set(starts))
        size, best = len(item), (0.0, 0, 0)
        pad = size // 2 + 4
        while starts:
            first = last = starts.pop(0)
            while starts and starts[0] - last <= pad:
                last = starts.pop(0)
            a, b = max(0, first - pad), min(len(ids), last + size + pad)
            score, end = align(item, ids[a:b])
            if score > best[0]:
                back, begin = align(item[::-1], ids[a : a + end][::-1])
                best = (score, a + end - begin, a + end)
        if best[0] >= threshold * MATCH * size:
            out.append((k, best[0] / (MATCH * size), best[1], best[2]))
    return out


def word_bits(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, float]:
    """-log2 of each word's share of all words in all documents."""
    numbers = {w: k for k, w in enumerate(vocabulary)}
    n = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        get = numbers.get
        for b in batches:
            for t in b.column("text"):
                total += np.bincount([get(w, n) for w in byte_words(t.as_py())], minlength=n + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["word", "n"])

    with text_batches(docs.sparkSession):
        counted = in_workers(docs.select(text_of(docs).alias("text")), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        rows = {r.word: r.n for r in counted.collect()}  # one row for each word of a block of the benchmark at most
    total = max(1, sum(rows.values()))
    return {w: float(np.log2((total + 1) / (rows.get(k, 0) + 0.5))) for k, w in enumerate(vocabulary)}


def blocks_of(docs: DataFrame, benchmark: DataFrame, rare_bits: float, block_chars: int) -> Iterator:
    """The benchmark's seeds, broadcast block by block."""
    spark = docs.sparkSession
    tests = benchmark.select("item_id", text_of(benchmark).alias("text")).distinct()
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    for block in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]  # about block_chars at most
        vocabulary = sorted({w for _, t in items for w in byte_words(t)})
        yield spark.sparkContext.broadcast(make_seeds(items, word_bits(docs, vocabulary), rare_bits))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare_bits: float = RARE_BITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: the items that each document holds, whole or edited; written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    given = docs.select("doc_id", text_of(docs).alias("text"))
    schema = given.select("doc_id").schema.add(benchmark.schema["item_id"]).add("score", "double").add("first_word", "long").add("end_word", "long")
    arrow = to_arrow_schema(schema)

    def matcher(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            values = values_of(max(1, len(seeds.words)))
            for b in batches:
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    rows += [(doc, i, score, a, e) for k, score, a, e in matches(seeds, values, text.as_py(), threshold) for i in seeds.ids[k]]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return work

    parts = []
    for sent in blocks_of(docs, benchmark, rare_bits, block_chars):
        with text_batches(spark):
            parts.append(stored(in_workers(given, matcher(sent), schema), work_dir(spark, "decontamination")))
    return reduce(DataFrame.unionByName, parts)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare_bits: float = RARE_BITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no test item, each judged by its own text; written."""
    spark, own = docs.sparkSession, free_name(docs, "text_")

    def rest(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            values = values_of(max(1, len(seeds.words)))
            for b in batches:
                clean = pa.array([not matches(seeds, values, t.as_py(), threshold) for t in b.column(own)], pa.bool_())
                yield b.filter(clean).drop_columns([own])

        return work

    left = docs
    for sent in blocks_of(docs, benchmark, rare_bits, block_chars):
        with text_batches(spark):
            left = stored(in_workers(left.select("*", text_of(left).alias(own)), rest(sent), docs.schema), work_dir(spark, "decontaminated"))
    return left
