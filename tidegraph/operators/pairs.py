"""Scores and features of node pairs over an adjacency."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegraph.functions.ordering import numbered
from tidegraph.operators.graph import LISTED, undirected
from tidegraph.plans.storage import stored

#: Neighbours that a task holds, and that are sent out at once: these bound memory, and the shuffles on disk.
HELD, SENT = 12_000_000, 250_000_000
#: Blocks of nodes at least: pairs of them are the tasks. Neighbours that are looked up at once.
BLOCKS, CHUNK = 6, 1 << 18
SCORES = ["cn", "aa", "jaccard", "pa"]


def directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v")).distinct()


class Near:
    """Neighbour lists of some nodes, and the degrees of the neighbours by code: codes from starts[i] on have degrees[i]."""

    def __init__(self, starts: list[int], degrees: list[int]):
        self.starts, self.parts = np.array(starts, np.int64), []
        d = np.array(degrees, np.float64)
        self.weights = np.divide(1.0, np.log(np.maximum(d, 2.0)), out=np.zeros(len(d)), where=d > 1)

    def add(self, nodes: np.ndarray, lists: pa.ListArray) -> None:
        self.parts.append((nodes, lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()))

    def built(self) -> None:
        """Sorted (node, code) keys, and a table of bits that most neighbours that are not there fall through."""
        nodes, sizes, codes = ([p[i] for p in self.parts] or [np.empty(0, np.int64)] for i in range(3))
        self.parts = []
        self.nodes, of = np.unique(np.concatenate(nodes), return_inverse=True)
        codes = np.concatenate(codes)
        self.width = int(codes.max()) + 1 if len(codes) else 1
        self.keys = np.repeat(of.astype(np.int64) * self.width, np.concatenate(sizes))
        self.keys += codes
        self.keys.sort()
        self.codes = (self.keys % self.width).astype(np.int32)
        self.begin = np.searchsorted(self.keys, np.arange(len(self.nodes) + 1) * self.width)
        bits = max(10, int(len(self.keys) * 16).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        for k in range(0, len(self.keys), CHUNK):
            h = self.hashed(self.keys[k : k + CHUNK])
            np.bitwise_or.at(self.table, h >> np.uint64(3), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each node, and its degree, 0 where it is not there."""
        if not len(self.nodes):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return at, np.where(self.nodes[at] == ids, self.begin[at + 1] - self.begin[at], 0)

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cn, aa and both degrees of pairs. What is looked up are the neighbours of the end with fewer."""
        (at_a, da), (at_b, db) = self.place(a), self.place(b)
        cn, aa = np.zeros(len(a), np.int64), np.zeros(len(a))
        asked = np.flatnonzero((da > 0) & (db > 0))
        out = (da <= db)[asked]
        few, many = np.where(out, at_a[asked], at_b[asked]), np.where(out, at_b[asked], at_a[asked])
        order = np.argsort(many * len(self.nodes) + few)  # what is near in memory is looked up together
        asked, few, base = asked[order], few[order], many[order] * self.width
        size = self.begin[few + 1] - self.begin[few]
        total = np.concatenate([[0], np.cumsum(size)])
        shift = self.begin[few] - total[:-1]
        for lo in range(0, int(total[-1]), CHUNK):
            hi = min(lo + CHUNK, int(total[-1]))
            i, j = np.searchsorted(total, lo, "right") - 1, np.searchsorted(total, hi, "left")
            n = np.minimum(total[i + 1 : j + 1], hi) - np.maximum(total[i:j], lo)
            keys = np.repeat(base[i:j], n)
            keys += self.codes[np.repeat(shift[i:j], n) + np.arange(lo, hi)]
            h = self.hashed(keys)
            hit = np.flatnonzero((self.table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
            found = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
            true = self.keys[found] == keys[hit]
            hit, found = hit[true], found[true]
            pair = np.searchsorted(total, hit + lo, "right") - 1
            weight = self.weights[np.searchsorted(self.starts, self.codes[found], "right") - 1]
            cn[asked[i:j]] += np.bincount(pair - i, minlength=j - i)
            aa[asked[i:j]] += np.bincount(pair - i, weight, minlength=j - i)
        return cn, aa, da, db


def _meeting(graphs: list[tuple[list[int], list[int]]], kept: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one task, sorted by kind: lists of graph 0, 1, ..., then pairs, which go on with what they have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, ready = [Near(*g) for g in graphs], False
        for batch in batches:
            kind = batch.column("__kind").to_numpy()
            for k, held in enumerate(near):
                lo, hi = np.searchsorted(kind, [k, k + 1])
                if hi > lo:
                    part = batch.slice(lo, hi - lo)
                    held.add(part.column("a").to_numpy().copy(), part.column("__near"))
            first = np.searchsorted(kind, len(near))
            if first == len(kind):
                continue
            if not ready:
                for held in near:
                    held.built()
                ready = True
            rows = batch.slice(first)
            a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(x) for held in near for x in held.met(a, b))], names=[*kept, *names])

    return run


def _lists(adjacency: DataFrame) -> tuple[DataFrame, tuple[list[int], list[int]], int]:
    """a, near: codes of the neighbours of each node, at most about LISTED a row; for Near: first code of each degree; rows of the adjacency.

    Codes are given in the order of degrees, of which there are at most about the square root of twice the rows.
    """
    adjacency = stored(adjacency.select("u", "v"), "adjacency")
    deg = stored(adjacency.groupBy("u").agg(F.count(F.lit(1)).alias("d")), "degrees")
    ends = adjacency.select("v").distinct().join(deg.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("d", F.lit(0)).cast("long").alias("d"))
    codes = stored(numbered(ends, ["d", "v"], "code"), "codes")
    first = sorted((x.code, x.d) for x in codes.groupBy("d").agg(F.min("code").alias("code")).collect())
    coded = adjacency.join(codes.select("v", F.col("code").cast("int").alias("code")), "v").join(deg, "u")
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("d") / LISTED))
    lists = coded.groupBy(F.col("u").alias("a"), part.alias("part")).agg(F.collect_list("code").alias("near")).drop("part")
    return stored(lists, "lists"), ([x[0] for x in first] or [0], [x[1] for x in first] or [0]), adjacency.count()


def common(pairs: DataFrame, adjacency: DataFrame, name: str = "", most: int = HELD) -> DataFrame:
    """pairs (a, b) with cn, aa: neighbours in common, and the sum of 1/ln(degree) over them (degrees of 1 give 0)."""
    return commons(pairs, {name: adjacency}, most).drop(f"da{name}", f"db{name}")


def commons(pairs: DataFrame, adjacencies: dict[str, DataFrame], most: int = HELD, sent: int = SENT) -> DataFrame:
    """pairs (a, b) with cn, aa, da, db (degrees of both ends) for each adjacency (u, v), named by its key.

    Nodes are dealt into blocks. A task gets the lists of two blocks, about `most` neighbours, and the pairs between
    them, each of which costs the neighbours of its end with fewer. Where all lists together would send over `sent`
    neighbours, the tasks are run in parts, one after the other.
    """
    spark = pairs.sparkSession
    pairs = stored(pairs, "asked")
    made = [_lists(adjacency) for adjacency in adjacencies.values()]
    rows = sum(n for *_, n in made)
    k = max(BLOCKS, -(-2 * rows // most))
    tasks = k * (k + 1) // 2
    parts = -(-k * rows // sent) or 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(k))
    cell = lambda x, y: (F.greatest(x, y) * (F.greatest(x, y) + 1) / 2 + F.least(x, y)).cast("int")
    names = [f"{c}{name}" for name in adjacencies for c in ("cn", "aa", "da", "db")]
    out = StructType(list(pairs.schema.fields))
    for c in names:
        out = out.add(c, "double" if c.startswith("aa") else "long")
    sides = [lists.select("a", F.lit(g).alias("__kind"), "near", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("other")).select("a", "__kind", F.col("near").alias("__near"), cell(block("a"), F.col("other")).alias("__cell")) for g, (lists, *_) in enumerate(made)]
    asked = pairs.withColumns({"__kind": F.lit(len(made)), "__near": F.lit(None).cast("array<int>"), "__cell": cell(block("a"), block("b"))})
    every = reduce(lambda x, y: x.unionByName(y, True), sides, asked)
    meet = _meeting([starts for _, starts, _ in made], pairs.columns, names)
    done = []
    for part in range(parts):
        here = every.where(F.pmod("__cell", F.lit(parts)) == part)
        dealt = here.repartitionById(-(-tasks // parts), F.floor(F.col("__cell") / parts).cast("int")).sortWithinPartitions("__kind")
        done.append(stored(dealt.drop("__cell").mapInArrow(meet, out), "common"))
        if parts > 1:
            spark._jvm.System.gc()  # Spark's cleaner then removes the shuffles of this part
    return reduce(DataFrame.unionByName, done)


def _jaccard(cn: str, da: str, db: str) -> Column:
    union = F.col(da) + F.col(db) - F.col(cn)
    return F.round(F.when(union > 0, F.col(cn) / union).otherwise(F.lit(0.0)), 6)


def scores(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with cn, aa, jaccard, pa over the undirected adjacency; unknown nodes score 0."""
    full = commons(pairs, {"": undirected(edges)})
    return full.select(*pairs.columns, "cn", F.round("aa", 6).alias("aa"), _jaccard("cn", "da", "db").alias("jaccard"), (F.col("da") * F.col("db")).alias("pa"))


def features_7(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """cn, log1p of it, aa, both over directed edges, jaccard, log1p of pa."""
    edges = stored(edges.select("src_idx", "dst_idx"), "edges")
    full = commons(pairs, {"": undirected(edges), "_dir": directed(edges)})
    log_pa = F.round(F.log1p(F.col("da") * F.col("db")), 6)
    return full.select(*pairs.columns, "cn", F.round(F.log1p("cn"), 6).alias("log_cn"), F.round("aa", 6).alias("aa"), "cn_dir", F.round("aa_dir", 6).alias("aa_dir"), _jaccard("cn", "da", "db").alias("jaccard"), log_pa.alias("log_pa"))


def features_34(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Node features of both ends (each 0 where unknown), and cn and aa over undirected and directed edges."""
    edges = stored(edges.select("src_idx", "dst_idx"), "edges")
    side = lambda end, name: nodes.select(F.col("node_idx").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    names = [f"{e}_{c}" for e in ("src", "dst") for c in columns]
    full = commons(pairs, {"_undir": undirected(edges), "_dir": directed(edges)})
    out = full.join(side("a", "src"), "a", "left").join(side("b", "dst"), "b", "left").fillna(0.0, names)
    return out.select(*pairs.columns, *names, "cn_undir", F.round("aa_undir", 6).alias("aa_undir"), "cn_dir", F.round("aa_dir", 6).alias("aa_dir"))


def features_joint(pairs: DataFrame, nodes: DataFrame, columns: list[str], extended: bool = False) -> DataFrame:
    """Features of both ends, all 0 where either is unknown; extended: their differences and products too."""
    side = lambda end, name: nodes.select(F.col("node_idx").alias(end), F.lit(1).alias(f"__{name}"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    both = pairs.join(side("a", "src"), "a", "left").join(side("b", "dst"), "b", "left")
    known = F.col("__src").isNotNull() & F.col("__dst").isNotNull()
    value = lambda e, c: F.when(known, F.coalesce(F.col(f"{e}_{c}"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = [value(e, c).alias(f"{e}_{c}") for e in ("src", "dst") for c in columns]
    if extended:
        out += [(value("src", c) - value("dst", c)).alias(f"diff_{c}") for c in columns] + [(value("src", c) * value("dst", c)).alias(f"prod_{c}") for c in columns]
    return both.select(*pairs.columns, *out)
