"""Exact substring deduplication with suffix arrays.

A byte goes if a string of `size` bytes covers it that also starts earlier, in a document with a smaller id or
earlier in the same one.

Routing. Every string of `size` bytes (a window) has an anchor: the k-gram in it with the least hash, the leftmost
among equals. Windows that share an anchor are one region of the text. Equal windows have equal anchors at equal
places, so windows need comparing only between regions of the same anchor string. Anchors that occur once are done.
Regions that are equal as a whole are sorted once, for their first occurrence; later occurrences go whole. Where an
anchor string has several different regions, the regions' bytes are brought together, runs of windows that occur
once there are left out, and a suffix array of the rest puts equal windows next to each other.

Suffix arrays are built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups are processed in
descending order with previous-smaller pointers, and a final pass emits each group's order from the array's own
beginning, without renaming and recursion.

Scale: only anchors (about one in 39 bytes, as hashes) are shuffled, and only those that repeat go on. Counts and
first occurrences are combined before shuffles, so a passage that a third of all documents share costs one row a
task there. An anchor with more than `cell` different regions is cut into its single windows, which group like whole
regions, so no task ever holds an unbounded cell. Texts are shuffled by id twice: to read the bytes of regions that
differ, and to cut.

Defined results: null counts as empty; windows never cross documents; rows that share an id (or have none; these come
first) are separate documents in an arbitrary, fixed order; an empty table gives an empty result; extra columns are
ignored. A document of any length is handled in pieces of its own bytes, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_workers, release, stored, text_batches, text_of, work_dir

SIZE, GRAM, CELL = 100, 24, 4096
#: Bytes hashed at once, unless one document is longer.
CHUNK = 1 << 20

_U = np.uint64
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _MIX1
    x = (x ^ x >> _U(27)) * _MIX2
    return x ^ x >> _U(31)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def regions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """Of documents at starts..ends in data: document, first window, windows, anchor's place from there, anchor hash, region hash."""
    if len(data) < size:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    hashes = Hashes(data)
    grams = mix(hashes.grams(gram))
    bits = max(1, int(len(data)).bit_length())
    low = _U((1 << bits) - 1)
    key = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    wide, have = size - gram + 1, 1
    while have * 2 <= wide:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    n = len(data) - size + 1
    place = (np.minimum(key[:n], key[wide - have : wide - have + n]) & low).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= size
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - size + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(windows):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    at = place[windows]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, count = windows[new], np.diff(np.append(new, len(windows)))
    anchor = at[new]
    doc = np.searchsorted(starts, first, "right") - 1
    # empty documents share their start with the next one; the last of them is the one that holds bytes
    whole = mix(hashes.of(first, first + count + size - 1) + count.astype(np.uint64) * _MIX1 + (anchor - first).astype(np.uint64) * _MIX2)
    return doc, first - starts[doc], count, anchor - first, grams[anchor], whole


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes."""
    first = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends[:-1]), ends


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of small positive integers, by linear grouping; the end counts as smallest.

    Groups hold suffixes with the same Lyndon prefix. In descending order, each member of a group finds the nearest
    earlier suffix in a lower group. Suffixes that were found equally often leave their own group together, for a new
    one just above it: their Lyndon prefix takes in that of the group that found them, so many times.
    """
    text = [*text, 0]
    n = len(text)
    heads: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        heads.setdefault(c, []).append(i)
    group, members, below = [0] * n, [], []  # members may hold suffixes that have left
    for g, c in enumerate(sorted(heads)):
        members.append(heads[c])
        below.append(g - 1)
        for i in heads[c]:
            group[i] = g
    smaller, done, order = [-1] * n, bytearray(n), []
    above = [*range(1, len(members)), -1]
    now = len(members) - 1
    while now >= 0:
        own = sorted([i for i in members[now] if group[i] == now])
        members[now] = own
        found: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and (done[j] or group[j] == now):
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        for i in own:
            done[i] = 1
        order.append(now)
        if len(found) == 1:
            times = found.items()
        else:
            times = sorted(found.items(), key=lambda x: -x[1])
        made: dict[tuple[int, int], int] = {}
        for j, k in times:
            g = group[j]
            new = made.get((g, k))
            if new is None:
                made[g, k] = new = len(members)
                members.append([])
                up = above[g]
                below.append(g)
                above.append(up)
                above[g] = new
                if up >= 0:
                    below[up] = new
            members[new].append(j)
            group[j] = new
        now = below[now]
    start, at = [0] * len(members), 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out, placed = [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out[1:]


def repeated_windows(cell: np.ndarray, key: np.ndarray, first: np.ndarray, texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (key, first window, windows) that also start earlier, among regions of the same cell."""
    none = np.zeros(0, np.int64)
    data, starts, ends = laid(texts)
    count = ends - starts - size + 1
    region = np.repeat(np.arange(len(texts)), count)
    step = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[region] + step
    hashes = Hashes(data)
    salt = mix(cell.astype(np.uint64))[region]
    _, inverse, times = np.unique(mix(hashes.of(at, at + size) ^ salt), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)  # windows that may repeat; the suffix array decides
    if not len(some):
        return none, none, none
    new = np.concatenate([[True], (some[1:] != some[:-1] + 1) | (region[some[1:]] != region[some[:-1]])])
    heads, run = np.flatnonzero(new), np.cumsum(new) - 1
    lengths = np.bincount(run)
    begin = at[some[heads]]
    _, one, of = np.unique(mix(hashes.of(begin, begin + lengths + size - 1) ^ salt[some[heads]] + lengths.astype(np.uint64)), return_index=True, return_inverse=True)
    # equal runs are sorted once; a mark stands between runs
    text, place = [], np.zeros(len(one), np.int64)
    for k, r in enumerate(one.tolist()):
        place[k] = len(text)
        text += data[begin[r] : begin[r] + lengths[r] + size - 1].tolist()
        text.append(256)
    codes = np.array(text, np.int64) + 1
    order = np.array(suffix_array(codes.tolist()), np.int64)
    whole = np.zeros(len(codes), bool)
    for k, r in enumerate(one.tolist()):
        whole[place[k] : place[k] + lengths[r]] = True
    order = order[whole[order]]
    views = np.lib.stride_tricks.sliding_window_view(codes.astype(np.int16), size)
    pairs = range(0, len(order) - 1, 20_000)
    equal = np.concatenate([np.zeros(0, bool), *((views[order[k : k + 20_000][: len(order) - 1 - k]] == views[order[k + 1 : k + 20_001]]).all(axis=1) for k in pairs)])
    classes = np.zeros(len(codes), np.int64)
    classes[order] = np.concatenate([[0], np.cumsum(~equal)])
    mine = classes[place[of][run] + some - some[heads][run]]
    k, p = key[region[some]], first[region[some]] + step[some]
    sort = np.lexsort((p, k, mine))
    late = np.zeros(len(some), bool)
    late[sort[1:]] = mine[sort[1:]] == mine[sort[:-1]]
    gone = np.flatnonzero(late)
    if not len(gone):
        return none, none, none
    heads = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (k[gone[1:]] != k[gone[:-1]]) | (p[gone[1:]] != p[gone[:-1]] + 1)]))
    return k[gone[heads]], p[gone[heads]], np.diff(np.append(heads, len(gone)))


def keyed(docs: DataFrame, base: str) -> DataFrame:
    """key (long, in the order of documents), doc_id, text."""
    given = docs.select("doc_id", text_of(docs).alias("text"))
    if dict(given.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
        if odd.isEmpty():
            return given.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    return stored(given.orderBy("doc_id", "text").withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text"), f"{base}/keyed")


def _anchors(size: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            keys = b.column("key").to_numpy()
            for first, last in chunks(texts):
                doc, at, count, off, h, w = regions(*laid(texts[first:last]), size, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + doc]), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(w.view(np.int64))],
                    names=["key", "first", "count", "h", "w"],
                )

    return work


PARTS = "h long, w long, key long, first int, count int, bytes binary"


def _parts(size: int):
    """Of documents with the regions wanted from them: bytes of a region, or the hashes of its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["h", "w", "key", "first", "count", "bytes"]
        for b in batches:
            rows: list[tuple] = []
            for key, text, wanted in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                hashes = None
                for x in wanted:
                    if not x["hot"]:
                        rows.append((x["h"], 0, key, x["first"], x["count"], data[x["first"] : x["first"] + x["count"] + size - 1]))
                        continue
                    if hashes is None:
                        hashes = Hashes(np.frombuffer(data, np.uint8))
                    at = np.arange(x["first"], x["first"] + x["count"])
                    for a, w in zip(at.tolist(), mix(hashes.of(at, at + size)).view(np.int64).tolist(), strict=True):
                        rows.append((x["h"], w, key, a, 1, None))
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names=names)

    return work


def _cells(size: int, most: int = CHUNK):
    names = ["key", "first", "count"]

    def done(t: pa.Table) -> pa.RecordBatch:
        k, a, n = repeated_windows(t.column("h").to_numpy(), t.column("key").to_numpy(), t.column("first").to_numpy().astype(np.int64), t.column("bytes").to_pylist(), size)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            held.append(b)
            total += b.nbytes
            if total < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column("h").to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1])
            if not len(cut):
                continue
            yield done(t.slice(0, int(cut[-1]) + 1))
            held = t.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
            total = sum(x.nbytes for x in held)
        if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield done(t)

    return work


def repeats(docs: DataFrame, base: str, size: int = SIZE, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """key, first, count: runs of windows that also start earlier, of the rows of keyed()."""
    spark = docs.sparkSession
    with text_batches(spark):
        found = stored(in_workers(docs.select("key", "text"), _anchors(size, gram), "key long, first int, count int, h long, w long"), f"{base}/anchors")
    # small sides are written before they are joined: only a join of plain exchanges can be split where a key is hot
    again = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), f"{base}/again")
    kept = stored(found.join(again, "h"), f"{base}/kept")
    release(spark, f"{base}/anchors", f"{base}/again")
    first = F.min(F.struct("key", "first")).alias("lead")
    groups = stored(kept.groupBy("h", "w").agg(first, F.max("count").alias("count"), F.count(F.lit(1)).alias("n")), f"{base}/groups")
    later = kept.join(groups.where("n > 1").select("h", "w", "lead"), ["h", "w"]).where(F.struct("key", "first") != F.col("lead")).select("key", "first", "count")
    later = stored(later, f"{base}/later")
    release(spark, f"{base}/kept")

    differ = stored(groups.groupBy("h").agg(F.count(F.lit(1)).alias("regions")).where("regions > 1"), f"{base}/differ")
    wanted = groups.join(differ, "h").select(F.col("lead.key").alias("key"), F.struct("h", F.col("lead.first").alias("first"), "count", (F.col("regions") > cell).alias("hot")).alias("x"))
    by_doc = wanted.groupBy("key").agg(F.collect_list("x").alias("wanted"))
    with text_batches(spark):
        parts = stored(in_workers(docs.select("key", "text").join(by_doc, "key"), _parts(size), PARTS), f"{base}/parts")
    release(spark, f"{base}/groups", f"{base}/differ")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cells = parts.where("bytes IS NOT NULL").select("h", "key", "first", "bytes").repartition(n, "h").sortWithinPartitions("h", "key", "first")
    sorted_out = in_workers(cells, _cells(size), "key long, first int, count int")
    single = parts.where("bytes IS NULL").select("h", "w", "key", "first")
    leads = stored(single.groupBy("h", "w").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w", "lead"), f"{base}/leads")
    alone = single.join(leads, ["h", "w"]).where(F.struct("key", "first") != F.col("lead")).select("key", "first", F.lit(1).alias("count"))
    out = stored(later.unionByName(sorted_out).unionByName(alone), f"{base}/repeats")
    release(spark, f"{base}/parts", f"{base}/later", f"{base}/leads")
    return out


def cut(docs: DataFrame, size: int = SIZE, gram: int = GRAM, cell: int = CELL, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with `text` the bytes that stay (kept)."""
    spark = docs.sparkSession
    base = work_dir(spark, "suffix-dedup")
    given = keyed(docs, base)
    runs = repeats(given, base, size, gram, cell).groupBy("key").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    full = given.join(runs, "key", "left").select("doc_id", "text", "runs")
    schema = given.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add("kept", "binary") if text else schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                data, kept, removed, spans, at = t.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                open_to = -1
                for a, e in sorted((r["first"], r["first"] + r["count"] + size - 1) for r in runs or ()):
                    if a > open_to:
                        spans += 1
                    if a > at:
                        kept.append(data[at:a])
                    at = max(at, e)
                    open_to = max(open_to, e)
                kept.append(data[at:])
                rest = b"".join(kept)
                removed = len(data) - len(rest)
                out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [b.column("doc_id"), *(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3], pa.string())]
            arrays += [pa.array(columns[4], pa.binary())] if text else []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    with text_batches(spark):
        out = stored(in_workers(full, work, schema), f"{base}/out")
    release(spark, f"{base}/repeats", f"{base}/keyed")
    return out
