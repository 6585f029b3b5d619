"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link when at most three differ. Split in two halves of 32 bits, at least one half
then differs in at most one bit. On a half the anchors are the words of a covering code: the perfect binary Golay
code on 23 bits (covering radius 3) times all words of the other 9 bits (radius 0). Each fingerprint has one home
anchor, the nearest, and visits every anchor within the covering radius plus the threshold of one bit; whatever is
within one bit of a fingerprint visits its home. Fingerprints are compared only within an anchor, by all 64 bits.

Scale: copies fall together before anchors are made, so a cell holds distinct fingerprints only. A half has 2^21
anchors; a cell that is hot all the same is cut into blocks, and pairs of blocks are compared in separate tasks. Of
the links within a comparison only a spanning forest leaves the task. Components come from rounds of large-star and
small-star over written tables; no links, labels or fingerprints go to the driver.

Defined results: null text is empty; a text without words has the fingerprint zero and links like any other; fewer
words than a shingle make one shingle. Rows with equal doc_id stay separate rows of equal component; a null doc_id
never names a component unless it has no other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.llm.common import free_name, in_workers, release, stored, text_batches, text_of, work_dir

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Rows of one comparison block; a cell with more is cut into blocks.
CELL_ROWS = 4096
GOLAY_BITS, RAW_BITS = 23, 9
GOLAY_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """A hash of each word shingle of the text, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 20, 09-0D only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    ones, n = np.zeros(64, np.int64), len(hashes)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 8192):
        ones += np.unpackbits(packed[k : k + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and fp (signed long); written."""
    spark, text = docs.sparkSession, free_name(docs, "text_")
    given = docs.select(*keep, text_of(docs).alias(text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fps], names=[*keep, "fp"])

    with text_batches(spark):
        return stored(in_workers(given, work, given.select(*keep).schema.add("fp", "long")), work_dir(spark, "fingerprints"))


class Golay:
    """Words of the Golay code near each of the 2^23 words, by syndrome."""

    def __init__(self) -> None:
        self.errors: dict[int, int] = {}
        for weight in range(4):
            for places in combinations(range(GOLAY_BITS), weight):
                error = sum(1 << p for p in places)
                self.errors[self.syndrome(error)] = error
        self.leader = np.array([self.errors[s] for s in range(1 << 11)], np.int64)
        self.table = np.array([self.syndrome(1 << p) for p in range(GOLAY_BITS)], np.int64)
        fours = [sum(1 << p for p in places) for places in combinations(range(GOLAY_BITS), 4)]
        by: dict[int, list[int]] = {}
        for error in fours:
            by.setdefault(self.syndrome(error), []).append(error)
        self.fours = np.full((1 << 11, max(map(len, by.values()))), -1, np.int64)
        for s, found in by.items():
            self.fours[s, : len(found)] = found

    @staticmethod
    def syndrome(word: int) -> int:
        for p in range(GOLAY_BITS - 1, 10, -1):
            if word >> p & 1:
                word ^= GOLAY_GENERATOR << (p - 11)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for p in range(GOLAY_BITS):
            out ^= np.where(words >> p & 1, self.table[p], 0)
        return out


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    _golay = _golay or Golay()
    return _golay


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index of the fingerprint, whether home. Bit 32 of an anchor tells the half."""
    code, found = golay(), []
    index = np.arange(len(fps))
    for half in (0, 1):
        bits = fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        words, raw = (bits & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64), (bits >> np.uint64(GOLAY_BITS)).astype(np.int64)
        syndromes = code.syndromes(words)
        home = words ^ code.leader[syndromes]
        at = lambda word, rest: word | rest << GOLAY_BITS | half << 32  # noqa: B023,E731
        found.append((at(home, raw), index, np.ones(len(fps), bool)))
        found += [(at(home, raw ^ 1 << k), index, np.zeros(len(fps), bool)) for k in range(RAW_BITS)]
        for errors in code.fours[syndromes].T:  # other words at a distance of exactly four
            some = errors >= 0
            found.append((at(words[some] ^ errors[some], raw[some]), index[some], np.zeros(int(some.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def spanning(home: np.ndarray, visit: np.ndarray, max_bits: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest that it reaches, over pairs of home and visit that are close enough."""
    nodes = np.unique(np.concatenate([home, visit]))
    label = np.arange(len(nodes))
    h, v = np.searchsorted(nodes, home), np.searchsorted(nodes, visit)
    for k in range(0, len(h), block):
        near = np.bitwise_count((home[k : k + block, None] ^ visit[None, :]).view(np.uint64)) <= max_bits
        i, j = np.nonzero(near)
        if len(i):
            label = roots_of(np.concatenate([np.arange(len(nodes)), h[k + i]]), np.concatenate([label, v[j]]), len(nodes))
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _cells(fps: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                anchor, index, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index]), pa.array(home)], names=["anchor", "fp", "home"])

    return in_workers(fps, work, "anchor long, fp long, home boolean")


def _compare(max_bits: int):
    def cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole cells, ordered by key."""
        key = np.stack([rows.column(c).to_numpy() for c in ("anchor", "x", "y")])
        fp, home = rows.column("fp").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        last = np.append(first[1:], len(fp))
        sizes, homes = last - first, np.add.reduceat(home.astype(np.int64), first)
        found_a, found_b = [], []
        # small cells together: every row against each row of its cell at a fixed distance from it
        small = (sizes <= 64) & (homes > 0) & (sizes > 1)
        cell = np.repeat(np.arange(len(first)), sizes)
        rows_in = np.flatnonzero(small[cell])
        end = last[cell]
        for d in range(1, int(sizes[small].max(initial=1))):
            rows_in = rows_in[rows_in + d < end[rows_in]]
            a, b = rows_in, rows_in + d
            near = (home[a] | home[b]) & (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= max_bits) & (fp[a] != fp[b])
            found_a.append(fp[a[near]])
            found_b.append(fp[b[near]])
        for k in np.flatnonzero((sizes > 64) & (homes > 0)):
            part, own = fp[first[k] : last[k]], home[first[k] : last[k]]
            a, b = spanning(part[own], part, max_bits)
            found_a.append(a)
            found_b.append(b)
        a, b = np.concatenate(found_a or [fp[:0]]), np.concatenate(found_b or [fp[:0]])
        links = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("anchor", "x", "y")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if not len(cut):  # a block of one cell, bounded by CELL_ROWS on either side
                continue
            yield from cells(t.slice(0, int(cut[-1]) + 1))
            held = t.slice(int(cut[-1]) + 1).to_batches()
            rows = sum(x.num_rows for x in held)
        if rows:
            yield from cells(pa.Table.from_batches(held).combine_chunks())

    return work


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct fingerprints (column fp) to links u > v that span each group of fingerprints within max_bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and a radius of one bit cover at most three differing bits")
    spark = fps.sparkSession
    cells = stored(_cells(fps), path := work_dir(spark, "simhash-cells"))
    size = cells.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    hot = size.where(F.col("n") > cell_rows).select("anchor", F.ceil(F.col("h") / cell_rows).cast("int").alias("hs"), F.ceil(F.col("n") / cell_rows).cast("int").alias("vs"))
    hot = stored(hot, hot_path := work_dir(spark, "simhash-hot"))
    # a cell of n rows is hs x vs blocks: home rows in block x meet all rows in block y
    place = F.pmod(F.xxhash64("fp"), F.lit(1 << 20))
    dealt = cells.join(hot, "anchor", "left").select("anchor", "fp", "home", F.coalesce("hs", F.lit(1)).alias("hs"), F.coalesce("vs", F.lit(1)).alias("vs"))
    plain = dealt.where("hs * vs = 1").select("anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "home")
    as_home = dealt.where("hs * vs > 1 AND home").select("anchor", F.pmod(place, F.col("hs")).cast("int").alias("x"), F.explode(F.expr("sequence(0, vs - 1)")).alias("y"), "fp", "home")
    as_visit = dealt.where("hs * vs > 1").select("anchor", F.explode(F.expr("sequence(0, hs - 1)")).alias("x"), F.pmod(place, F.col("vs")).cast("int").alias("y"), "fp", F.lit(False).alias("home"))
    blocks = plain.unionByName(as_home).unionByName(as_visit) if not hot.isEmpty() else cells.select("anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "home")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = blocks.repartition(n, "anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")
    found = in_workers(met, _compare(max_bits), "u long, v long").distinct()
    out = stored(found, work_dir(spark, "simhash-links"))
    release(spark, path, hot_path)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Links u-v to (node, root): the smallest node of its component, for every node with a link.

    Rounds of large star and small star. Each round writes its links once, and a sum of their hashes told on the way
    shows when they no longer change. Aggregates are written before they are joined: then a hot star can be split.
    """
    spark = edges.sparkSession
    base, k, before = work_dir(spark, "components"), 0, None

    def written(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        told = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        out = stored(told, f"{base}/{name}")
        return out, tuple(seen.get.values()) or (0, None)

    now, told = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    while told != before and told[0]:
        # u > v in all links: a node's smaller neighbours are its v, its larger ones stand where it is v
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{base}/low-{k}")
        large = now.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, f"{base}/large-{k}")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{base}/least-{k}")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before = told
        new, told = written(small, str(k + 1))
        release(spark, *(f"{base}/{x}-{k}" for x in ("low", "large", "least")), f"{base}/{k}")
        now, k = new, k + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a row's fingerprint reaches."""
    spark = docs.sparkSession
    base = work_dir(spark, "simhash")
    fps = fingerprints(docs, shingle)
    ids = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{base}/ids")
    roots = components(links(ids.select("fp"), max_bits, cell_rows))
    rooted = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(rooted.join(named, "root").select("fp", "component_id"), f"{base}/of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, of each component the document with the smallest doc_id. doc_id is expected to be unique; rows without one stay."""
    own = free_name(docs, "gone_")
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
