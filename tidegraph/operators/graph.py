"""Graph algorithms as rounds of joins over written tables."""

from __future__ import annotations

import itertools
import math
import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.storage import stored

#: No key: behind all others.
NONE = np.iinfo(np.int64).max
#: About so many neighbours of a node stand in one row.
LISTED = 4096
#: Of a TPPR fold: nodes whose state is in memory, edges in a chunk, and edges that are worked out together.
STATES, EDGES, TOGETHER = 65_536, 32_768, 2048
#: Pairs whose states are brought together at once, at most about.
MET = 500_000


def undirected(edges: DataFrame) -> DataFrame:
    """u, v: each distinct pair in both directions, without self loops."""
    e = edges.where("src_idx <> dst_idx")
    both = e.select(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v")).unionByName(e.select(F.col("dst_idx").alias("u"), F.col("src_idx").alias("v")))
    return both.distinct()


def oriented(adjacency: DataFrame) -> DataFrame:
    """Each pair once, from the end with the smaller degree (ties: smaller id): no node keeps many successors. dv: degree of v."""
    deg = adjacency.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    pairs = adjacency.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    return pairs.where((F.col("d") < F.col("dv")) | ((F.col("d") == F.col("dv")) & (F.col("u") < F.col("v")))).select("u", "v", "dv")


def wedges(up: DataFrame) -> DataFrame:
    """u, v, w: two successors of u, once, in the order in which a pair of them would be oriented."""
    other = up.select("u", F.col("v").alias("w"), F.col("dv").alias("dw"))
    return up.join(other, "u").where((F.col("dv") < F.col("dw")) | ((F.col("dv") == F.col("dw")) & (F.col("v") < F.col("w")))).select("u", "v", "w")


def triangles(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering of every node with a neighbour.

    Each pair is asked once for its neighbours in common; a triangle of a node then counts in two of its pairs.
    """
    from tidegraph.operators.pairs import commons

    adjacency = stored(undirected(edges), "adjacency")
    met = commons(adjacency.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")), {"": adjacency})
    end = lambda c: F.struct(F.col(c).alias("node"), F.col(f"d{c}").alias("degree"), "cn")
    per_node = met.select(F.explode(F.array(end("a"), end("b"))).alias("x")).select("x.*").groupBy("node").agg(F.max("degree").alias("degree"), (F.sum("cn") / 2).cast("long").alias("triangles"))
    d, t = F.col("degree"), F.col("triangles")
    return per_node.select("node", "degree", "triangles", F.when(d > 1, 2 * t / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node, rank. Weights are event counts; the mass of nodes without successors is spread evenly.

    With a tolerance, the vector before the one that moved less than it (in L1) is returned.
    """
    links = edges.groupBy(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    out = links.groupBy("u").agg(F.sum("w").alias("total"))
    links = stored(links.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")), "links")
    nodes = stored(links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct().join(out.select(F.col("u").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")), "nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
        came = links.join(rank.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("came"))
        base = (1 - alpha) / n + alpha * lost / n if n else 0.0
        new = stored(rank.join(came, "node", "left").select("node", "dangling", (F.lit(base) + alpha * F.coalesce("came", F.lit(0.0))).alias("new"), "rank"), "rank")
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] if tolerance else 1.0
        if tolerance and (moved or 0.0) < tolerance:
            break
        rank = new.select("node", "dangling", F.col("new").alias("rank"))
    total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("node", (F.col("rank") / total).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each weakly connected component."""
    both = stored(undirected(edges), "both")
    label = stored(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct(), "label")
    while True:
        low = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("low"))
        near = label.join(low, label.node == low.u).select("node", "component", F.least("component", "low").alias("new"))
        # jump: the component of a component is one as well
        jump = label.select(F.col("node").alias("new"), F.col("component").alias("far"))
        new = stored(near.join(jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", F.coalesce("far", "new")).alias("component")), "label")
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def core_numbers(edges: DataFrame, listed: int = LISTED) -> DataFrame:
    """node, core: fixpoint of replacing each node's number by the h-index of its neighbours' numbers.

    A node keeps how many neighbours have which number, up to its own. Pairs are dealt once, as lists of at most about
    `listed` neighbours; after that only nodes whose number has fallen tell those that it may fall short of.
    """
    spark, both = edges.sparkSession, stored(undirected(edges), "both")
    core = stored(both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core")), "core")
    own = lambda c, d: core.select(F.col("node").alias(c), F.col("core").alias(d))
    known = stored(both.join(own("v", "dv"), "v").join(own("u", "du"), "u"), "known")
    near = known.groupBy(F.col("v").alias("node"), F.pmod(F.xxhash64("u"), F.ceil(F.col("dv") / listed)).alias("part"))
    near = stored(near.agg(F.collect_list(F.struct("u", F.col("du").alias("most"))).alias("near")).drop("part"), "near")
    held = stored(known.groupBy(F.col("u").alias("node"), F.least("dv", "du").alias("value")).agg(F.count(F.lit(1)).alias("n")), "held")
    while True:
        spark._jvm.System.gc()  # Spark's cleaner then removes the shuffles of the round before
        above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
        h = held.withColumn("m", F.least("value", above)).groupBy("node").agg(F.max("m").alias("new"))
        new = stored(core.join(h, "node").select("node", F.col("core").alias("old"), F.least("core", "new").alias("core")), "core")
        core, fallen = new.select("node", "core"), new.where("old <> core")
        if fallen.isEmpty():
            return core
        # where a neighbour's number was never above the new one, nothing changes for it
        told = near.join(fallen, "node").select("old", "core", F.explode(F.filter("near", lambda x: x["most"] > F.col("core"))).alias("x"))
        entry = lambda c, k: F.struct(F.least(F.col(c), F.col("x.most")).alias("value"), F.lit(k).cast("long").alias("n"))
        told = told.select(F.col("x.u").alias("node"), F.explode(F.array(entry("old", -1), entry("core", 1))).alias("e")).select("node", "e.*")
        told = told.groupBy("node", "value").agg(F.sum("n").alias("n"))
        held = held.unionByName(told).join(core, "node").groupBy("node", F.least("value", "core").alias("value")).agg(F.sum("n").alias("n"))
        held = stored(held.where("n <> 0"), "held")


def strong_components_of(src: list[int], dst: list[int]) -> dict[int, int]:
    """Node to the smallest node of its strongly connected component, without recursion."""
    after: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack, held, out = [], set(), {}
    for start in after:
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        held.discard(part[-1])
                        if part[-1] == node:
                            break
                    least = min(part)
                    out.update(dict.fromkeys(part, least))
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                held.add(nxt)
                work.append((nxt, iter(after[nxt])))
            elif nxt in held:
                low[node] = min(low[node], index[nxt])
    return out


def daily_strong_components(daily: DataFrame) -> DataFrame:
    """date, node, component of each day's graph; a day's distinct pairs are one group."""

    def of_day(day: pd.DataFrame) -> pd.DataFrame:
        found = strong_components_of(day["src_idx"].tolist(), day["dst_idx"].tolist())
        return pd.DataFrame({"date": day["date"].iloc[0], "node": list(found), "component": list(found.values())})

    return daily.select("date", "src_idx", "dst_idx").distinct().groupBy("date").applyInPandas(of_day, "date date, node long, component long")


def tppr_fold(rows: Iterator[tuple[int, int]], alpha: float, beta: float, k: int) -> tuple[dict[int, dict[int, float]], dict[int, float]]:
    """Incremental personalised PageRank of both ends of each edge, in time order: the top k weights and a norm a node."""
    top: dict[int, dict[int, float]] = {}
    norm: dict[int, float] = {}
    for a, b in rows:
        before = {x: (dict(top.get(x, {})), norm.get(x, 0.0)) for x in (a, b)}
        for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
            (own, n), (other, _) = before[x], before[y]
            now = n * beta + beta
            share = (1 - alpha) * (beta / now if n else 1.0)  # a node's first edge has nothing to be weighed against
            mixed = {key: w * (n * beta / now) for key, w in own.items()}
            for key, w in other.items():
                mixed[key] = mixed.get(key, 0.0) + share * w
            mixed[y] = mixed.get(y, 0.0) + (share * alpha if alpha else share)
            top[x] = dict(sorted(mixed.items(), key=lambda e: (-e[1], e[0]))[:k])
            norm[x] = now
    return top, norm


def tppr_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each edge in time order, one more than the last level of either end: edges of a level share no end."""
    last: dict[int, int] = {}
    out = np.empty(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[k] = last[x] = last[y] = max(last.get(x, -1), last.get(y, -1)) + 1
    return out


def tppr_update(ids: np.ndarray, keys: np.ndarray, weights: np.ndarray, norm: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float, beta: float, k: int) -> None:
    """tppr_fold of edges in time order, equal to the last bit, into the state of the nodes ids; a, b: places in ids.

    An edge changes only its ends, so edges that share none are worked out together, level by level. A node's weights are
    held as k keys in order (NONE behind the last) and their weights.
    """
    level = tppr_levels(a, b)
    order = np.argsort(level, kind="stable")
    of_level = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)
    for edges in (part[lo : lo + TOGETHER] for part in of_level for lo in range(0, len(part), TOGETHER)):
        two = edges[a[edges] != b[edges]]
        x, y = np.concatenate([a[edges], b[two]]), np.concatenate([b[edges], a[two]])
        n = norm[x]
        now = n * beta + beta
        share = (1 - alpha) * np.where(n > 0, beta / now, 1.0)  # a node's first edge has nothing to be weighed against
        # own weights, those of the other end and the other end itself; equal keys come to stand in this order
        key = np.concatenate([keys[x], keys[y], ids[y, None]], axis=1)
        w = np.concatenate([weights[x] * (n * beta / now)[:, None], weights[y] * share[:, None], (share * alpha if alpha else share)[:, None]], axis=1)
        by_key = np.argsort(key, axis=1, kind="stable") + np.arange(len(x))[:, None] * key.shape[1]
        key, w = key.ravel()[by_key], w.ravel()[by_key]
        again = key[:, 1:] == key[:, :-1]
        total = w.copy()
        total[:, :-1] += w[:, 1:] * again
        total[:, :-2] += w[:, 2:] * (again[:, 1:] & again[:, :-1])
        kept = key != NONE
        kept[:, 1:] &= ~again
        total[~kept] = -1.0
        # the k largest; of those that equal the last of them, the smallest keys
        least = np.partition(total, -k, axis=1)[:, -k, None]
        kept &= total >= least
        if (kept.sum(axis=1) > k).any():
            above, tied = kept & (total > least), kept & (total == least)
            kept = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))
        size, found = kept.sum(axis=1), np.flatnonzero(kept)
        place = np.arange(len(found)) + np.repeat(np.arange(len(x)) * k - np.cumsum(size) + size, size)
        new_keys, new_weights = np.full((len(x), k), NONE), np.zeros((len(x), k))
        new_keys.ravel()[place], new_weights.ravel()[place] = key.ravel()[found], total.ravel()[found]
        keys[x], weights[x], norm[x] = new_keys, new_weights, now


def tppr_by_level(a: np.ndarray, b: np.ndarray, alpha: float, beta: float, k: int) -> tuple[np.ndarray, list[list[tuple[int, float]]], np.ndarray]:
    """tppr_fold of edges in time order: nodes, their top k keys with weights, norms."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, weights, norm = np.full((len(nodes), k), NONE), np.zeros((len(nodes), k)), np.zeros(len(nodes))
    tppr_update(nodes, keys, weights, norm, at[: len(a)], at[len(a) :], alpha, beta, k)
    top = []
    for own, w in zip(keys, weights, strict=True):
        by_weight = np.argsort(-w[own != NONE], kind="stable")
        top.append(list(zip(own[by_weight].tolist(), w[by_weight].tolist(), strict=True)))
    return nodes, top, norm


class TpprStore:
    """Rows of k keys, k weights and a norm by node: the first `held` nodes in memory, all others in a file of the task."""

    def __init__(self, k: int, held: int):
        self.k, self.ids, self.at, self.file = k, np.empty(0, np.int64), np.empty(0, np.int64), None
        self.row = np.dtype([("keys", np.int64, (k,)), ("weights", np.float64, (k,)), ("norm", np.float64)])
        self.held, self.rows = held, np.empty(0, self.row)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of sorted distinct nodes; new nodes come behind the others."""
        near = np.searchsorted(self.ids, ids)
        old = np.zeros(len(ids), bool)
        if len(self.ids):
            old = self.ids[np.minimum(near, len(self.ids) - 1)] == ids
        n = len(self.ids)
        self.at = np.insert(self.at, near[~old], np.arange(n, n + (~old).sum()))
        self.ids = np.insert(self.ids, near[~old], ids[~old])
        return self.at[np.searchsorted(self.ids, ids)]

    def _runs(self, at: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """lo, hi, offset in the file of places that follow one another, of those that are not held."""
        far = at[order]
        ends = np.flatnonzero(np.diff(far) != 1) + 1
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(far)], strict=True):
            if hi > lo:
                yield lo, hi, (int(far[lo]) - self.held) * self.row.itemsize

    def load(self, at: np.ndarray, known: int) -> np.ndarray:
        """Rows of places; those from `known` on are new."""
        out = np.zeros(len(at), self.row)
        out["keys"] = NONE
        near = np.flatnonzero(at < min(known, self.held))
        out[near] = self.rows[at[near]]
        far = np.flatnonzero((at >= self.held) & (at < known))
        far = far[np.argsort(at[far])]
        found = np.empty(len(far), self.row)
        for lo, hi, offset in self._runs(at, far):
            os.preadv(self.file.fileno(), [memoryview(found[lo:hi]).cast("B")], offset)
        out[far] = found
        return out

    def save(self, at: np.ndarray, rows: np.ndarray) -> None:
        want = min(len(self.ids), self.held)
        if want > len(self.rows):
            grown = np.empty(min(self.held, max(want, 2 * len(self.rows))), self.row)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        near = np.flatnonzero(at < self.held)
        self.rows[at[near]] = rows[near]
        far = np.flatnonzero(at >= self.held)
        if len(far):
            self.file = self.file or tempfile.TemporaryFile()
            far = far[np.argsort(at[far])]
            sent = rows[far]
            for lo, hi, offset in self._runs(at, far):
                os.pwritev(self.file.fileno(), [memoryview(sent[lo:hi]).cast("B")], offset)

    def fold(self, a: np.ndarray, b: np.ndarray, alpha: float, beta: float) -> None:
        known = len(self.ids)
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        at = self.places(ids)
        rows = self.load(at, known)
        keys, weights, norm = (np.ascontiguousarray(rows[c]) for c in ("keys", "weights", "norm"))
        tppr_update(ids, keys, weights, norm, ends[: len(a)], ends[len(a) :], alpha, beta, self.k)
        rows["keys"], rows["weights"], rows["norm"] = keys, weights, norm
        self.save(at, rows)

    def batches(self, size: int = 2048) -> Iterator[pa.RecordBatch]:
        """node, weights (largest first, ties by key), norm of all nodes."""
        order = np.argsort(self.at)
        for lo in range(0, len(order), size):
            at = self.at[order[lo : lo + size]]
            rows = self.load(at, len(self.ids))
            there = rows["keys"] != NONE
            by_weight = np.argsort(np.where(there, -rows["weights"], 1.0), axis=1, kind="stable")
            there = np.take_along_axis(there, by_weight, axis=1)
            keys, weights = (np.take_along_axis(rows[c], by_weight, axis=1)[there] for c in ("keys", "weights"))
            starts = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(keys), pa.array(weights)], names=["node", "weight"])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[order[lo : lo + size]]), pa.ListArray.from_arrays(pa.array(starts), entries), pa.array(np.ascontiguousarray(rows["norm"]))], names=["node", "weights", "norm"])


def tppr(edges: DataFrame, alpha: float = 0.9, beta: float = 0.8, k: int = 100, held: int = STATES, chunk: int = EDGES) -> DataFrame:
    """node, weights, norm: the state after all edges. Updates never leave a weak component, so each goes to one task.

    A task folds its edges in time order in chunks; of the state, it keeps about `held` nodes in memory.
    """
    parts = components(edges)
    placed = edges.select("src_idx", "dst_idx", "edge_seq").join(parts.withColumnRenamed("node", "src_idx"), "src_idx")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ends, n = TpprStore(k, held), [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                ends.append([batch.column(c).to_numpy().copy() for c in ("src_idx", "dst_idx")])
                n += batch.num_rows
            if n and (n >= chunk or batch is None):
                a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
                for lo in range(0, n, chunk):
                    state.fold(a[lo : lo + chunk], b[lo : lo + chunk], alpha, beta)
                ends, n = [], 0
        yield from state.batches()

    # a given number of partitions, since small ones would be put together and folded one after the other
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = placed.repartition(parts, "component").sortWithinPartitions("edge_seq").select("src_idx", "dst_idx")
    out = dealt.mapInArrow(fold, "node long, weights array<struct<node:long,weight:double>>, norm double")
    return out.withColumn("weights", F.map_from_entries("weights"))


def tppr_similarity(state: DataFrame, pairs: DataFrame, most: int = MET) -> DataFrame:
    """src, dst, similarity: dot product of the weights, and half of the direct weights both ways.

    A pair takes both states along, so over `most` pairs are dealt by blocks of sources and destinations, one after the other.
    """
    k = math.ceil(math.sqrt(pairs.count() / most)) or 1
    if k == 1:
        return _tppr_similarity(state, pairs)
    done = []
    for i, j in itertools.product(range(k), repeat=2):
        of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(k)) == n
        done.append(stored(_tppr_similarity(state, pairs.where(of("src", i) & of("dst", j)), of("node", i), of("node", j)), "similar"))
        pairs.sparkSession._jvm.System.gc()  # Spark's cleaner then removes the shuffles of this part
    return reduce(DataFrame.unionByName, done)


def _tppr_similarity(state: DataFrame, pairs: DataFrame, left: Column | bool = True, right: Column | bool = True) -> DataFrame:
    a = state.where(F.lit(True) if left is True else left).select(F.col("node").alias("src"), F.col("weights").alias("wa"))
    b = state.where(F.lit(True) if right is True else right).select(F.col("node").alias("dst"), F.col("weights").alias("wb"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")
    empty = F.create_map().cast("map<bigint,double>")
    wa, wb = F.coalesce("wa", empty), F.coalesce("wb", empty)
    dot = F.aggregate(F.map_entries(wa), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(wb, e["key"]), F.lit(0.0)))
    direct = F.coalesce(F.try_element_at(wa, F.col("dst")), F.lit(0.0)) + F.coalesce(F.try_element_at(wb, F.col("src")), F.lit(0.0))
    return both.select("src", "dst", (dot + 0.5 * direct).alias("similarity"))
