"""Near copies by the similarity of their shingles: every pair of texts with a Jaccard similarity of 0.8 or more.

A text is the set of its five-word shingles (64-bit hashes). Shingles are put in one order for all texts, rare ones
first; two texts that are similar enough then share a shingle among the first fifth of each (prefix filter), so every
such pair meets in the cell of a shingle. The first of these that both share is the one that counts: all else they share
stands behind it in both, so a pair meets only where this can be enough, and not where both have the same shingle before
it. Pairs are also left out whose sketches differ too much: a sketch has a bit for the parity of the shingles in each of SKETCH parts of the hashes, so two sets differ in
at least as many shingles as their sketches in bits. Each text has one sketch of at least two bits a shingle, which is
folded where shorter ones do. The others are compared by their whole sets, made from the texts where they meet: texts
are shorter than sets and are sent once a pair. Nothing is estimated: the order comes from a sample, but any order gives the same pairs.

Scale: a text leaves a row for a fifth of its shingles, and only cells with two texts or more go on. First every text
is held against one leader of one of its cells. While cells hold over HOT_ROOTS components, their texts are then held
against LEADERS of them a round, for as long as that links them; a large group of copies is then one component, at a
cost in proportion to its rows. Only pairs in a cell whose texts are not yet linked are met after that, and all of them
are: unlike texts that share a rare shingle still cost the square of their number in comparisons of sketches, and in
rows where it stands among the first ninth of both and they are too long for the short sketches. A cell that is hot all the same is
cut into blocks, and pairs of blocks are met in separate tasks. What is broadcast is the COMMON most frequent shingles
of a sample, which only order shingles.

Defined results: null text is empty; texts without words are equal; fewer words than a shingle make one shingle. A
row without an id can't be told from others without one, and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import free_name, in_workers, release, stored, text_batches, text_of, work_dir
from tidegraph.llm.simhash import components, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
SAMPLE_DOCS, COMMON = 5_000, 100_000
CELL_ROWS = 1024
STAR_ROUNDS = 1
#: Cells with more components than this are held against so many leaders a round; rounds end when one links under a tenth.
HOT_ROOTS, LEADERS = 24, 4
#: So many of a text's leaders, the closest by their sketches, are compared with it in a round.
CLOSEST = 2
#: Bits of a short sketch, a power of two and a multiple of 64.
SKETCH = 256
WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def grams(text: str) -> np.ndarray:
    """Distinct shingles of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE) or [0], np.uint64).view(np.int64))


def _grams(docs: DataFrame) -> DataFrame:
    """id, grams of docs (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "grams"])

    return in_workers(docs, work, "id long, grams array<long>")


def sketch(own: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """The parity of the number of shingles in each part, as words of 64 bits."""
    parts = np.bincount((own.view(np.uint64) % np.uint64(bits)).view(np.int64), minlength=bits)
    return np.packbits((parts & 1).astype(np.uint8)).view(np.int64)


def long_sketch(own: np.ndarray) -> bytes:
    """A sketch of at least two bits a shingle."""
    return sketch(own, max(SKETCH, 1 << (2 * len(own) - 1).bit_length())).tobytes()


def folded(long: bytes, size: int) -> np.ndarray:
    """The sketch of `size` bytes that a longer one holds: the parts of both are remainders by powers of two."""
    return np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, size), axis=0)


def bits_apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _short(sketches: DataFrame) -> DataFrame:
    """id and the words of the short sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([folded(x.as_py(), SKETCH // 8) for x in b.column("sketch")], np.uint8).reshape(-1, SKETCH // 8).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x) for x in found.T)], names=["id", *WORDS])

    return in_workers(sketches.select("id", "sketch"), work, "id long, " + ", ".join(f"{w} long" for w in WORDS))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and how many of its texts have them."""
    n = max(1, docs.count())
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_DOCS / n) * (1 << 20)))
    counted = _grams(sample).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow().sort_by("gram")
    return rows.column("gram").to_numpy(), rows.column("n").to_numpy()


def first_grams(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """As many of a text's rarest shingles that a similar text must have one of them among its own."""
    seen = np.zeros(len(own), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        seen = np.where(common[0][at] == own, common[1][at], 0)
    return own[np.lexsort((own, seen))][: len(own) + OVER * len(own) // -UNDER + 1]


def _prefixes(docs: DataFrame, sent) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            sets = [grams(t.as_py()) for t in b.column("text")]
            firsts = [first_grams(s, common) for s in sets]
            sizes = [len(f) for f in firsts]
            columns = [
                np.concatenate([*firsts, np.zeros(0, np.int64)]),
                np.repeat(b.column("id").to_numpy(), sizes),
                np.repeat(np.array([len(s) for s in sets], np.int32), sizes),
                np.concatenate([*(np.arange(k, dtype=np.int32) for k in sizes), np.zeros(0, np.int32)]),
            ]
            long = [long_sketch(s) for s in sets]
            # with a text's first row, empty in the others
            lengths = np.zeros(sum(sizes), np.int32)
            lengths[np.cumsum([0, *sizes])[:-1]] = [len(x) for x in long]
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
            sketches = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(long))])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), sketches], names=["gram", "id", "n", "place", "sketch"])

    return in_workers(docs, work, "gram long, id long, n int, place int, sketch binary")


def may_start(n_a, n_b, at_a, at_b):
    """Whether texts of n_a and n_b shingles can be similar enough where those at at_a and at_b are the first they share."""
    return (OVER + UNDER) * np.minimum(n_a - at_a, n_b - at_b) >= OVER * (n_a + n_b)


def may_differ(n_a, n_b, bits):
    """Whether texts of n_a and n_b shingles that differ in so many shingles, or more, can be similar enough."""
    return (OVER + UNDER) * bits <= (UNDER - OVER) * (n_a + n_b)


def _still_may(n_u: str, n_v: str) -> Column:
    """The same of pairs that share `c` first shingles, the last of them at at_u and at_v.

    One of the two sets of first shingles ends before the other; all else that is shared stands behind that end.
    """
    behind = F.least(F.least(F.col(n_u) - F.col("at_u"), F.col(n_v) - F.col("at_v")) - 1, F.greatest(*(F.expr(f"({OVER} * {n} + {UNDER - 1}) div {UNDER} - 1") for n in (n_u, n_v))))
    most = F.col("c") + behind
    return (OVER + UNDER) * most >= OVER * (F.col(n_u) + F.col(n_v))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs u > v of the rows of each cell; batches are ordered by cell (gram, x, y).

    `before` is the shingle in front of `gram` among those of the text that are left, or gram itself: where two texts
    have the same one they meet in its cell.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([t.column(c).to_numpy() for c in ("gram", "x", "y")])
        ids, n, place, side, root, before = (t.column(c).to_numpy() for c in ("id", "n", "place", "side", "root", "before"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        bits = [t.column(w).to_numpy() for w in WORDS]
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.append(first, len(ids)))
        end = np.repeat(first + sizes, sizes)
        rows, found = np.flatnonzero(np.repeat(sizes > 1, sizes)), []
        for d in range(1, int(sizes.max(initial=1))):
            rows = rows[rows + d < end[rows]]
            a, b = rows, rows + d
            near = may_start(n[a], n[b], place[a], place[b]) & (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 2))
            near &= (before[a] != before[b]) | (before[a] == key[0, a])
            a, b = a[near], b[near]
            differ = sum(np.bitwise_count((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in bits)
            near = may_differ(n[a], n[b], differ)
            a, b = a[near], b[near]
            found.append(np.stack([np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])]))
            if sum(x.shape[1] for x in found) > 500_000:
                yield batch(found)
                found = []
        yield batch(found)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.unique(np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 200_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([t.column(c).to_numpy() for c in ("gram", "x", "y")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if not len(cut):  # a pair of blocks, bounded by CELL_ROWS on either side
            continue
        yield from pairs(t.slice(0, int(cut[-1]) + 1))
        held = t.slice(int(cut[-1]) + 1).to_batches()
        rows = sum(x.num_rows for x in held)
    if rows:
        yield from pairs(pa.Table.from_batches(held).combine_chunks())


def cells(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram, id, n, place of the first shingles that two texts or more have among their first; id, n, sketch of each text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_common(docs))
    rows = stored(_prefixes(docs, sent), path := work_dir(spark, "near-prefixes"))
    again = stored(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"), again_path := work_dir(spark, "near-again"))
    out = stored(rows.select("gram", "id", "n", "place").join(again, "gram"), work_dir(spark, "near-cells"))
    sketches = stored(rows.where("place = 0").select("id", "n", "sketch"), work_dir(spark, "near-sketches"))
    release(spark, path, again_path)
    return out, sketches


def star(found: DataFrame, k: int) -> DataFrame:
    """u > v: for each text a pair with one leader of its cells, that of most of them; other leaders in each round k."""
    spark = found.sparkSession
    own = F.struct("id", "n", "place")
    lead = stored(found.groupBy("gram").agg(F.min_by(own, F.xxhash64("id", F.lit(k))).alias("lead")), work_dir(spark, "near-leaders"))
    met = found.select("gram", own.alias("own")).join(lead, "gram").where(F.col("own.id") != F.col("lead.id"))
    at = F.max(F.struct("own.place", F.col("lead.place").alias("other")))
    pairs = met.groupBy(F.col("own.id").alias("u"), F.col("lead.id").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.max("own.n").alias("n_u"), F.max("lead.n").alias("n_v"), at.alias("at"))
    pairs = pairs.select("u", "v", "c", "n_u", "n_v", F.col("at.place").alias("at_u"), F.col("at.other").alias("at_v")).where(_still_may("n_u", "n_v"))
    one = pairs.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
    return stored(one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), work_dir(spark, "near-star"))


def hot_rows(left: DataFrame, hot_roots: int = HOT_ROOTS) -> tuple[DataFrame, int]:
    """The rows of cells with more than hot_roots components, and the number of components summed over these cells."""
    spark = left.sparkSession
    hot = left.select("gram", "root").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("roots")).where(F.col("roots") > hot_roots)
    hot = stored(hot, work_dir(spark, "near-hot-roots"))
    return left.join(hot.select("gram"), "gram"), hot.agg(F.coalesce(F.sum("roots"), F.lit(0))).first()[0]


def most_frequent(values: np.ndarray, most: int) -> np.ndarray:
    """The `most` values that occur most often; of values that occur as often, the smallest."""
    found, n = np.unique(values, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:most]]


def led(rows: DataFrame, k: int, leaders: int = LEADERS) -> DataFrame:
    """own, u > v: each text (own) with those of the leaders of its cells, of another component, that it shares most cells with.

    At most `leaders` a text; other leaders in each round k. What is left out here is met by `candidates`. The join makes
    one row for each row of a cell, and one list for each text.
    """
    spark = rows.sparkSession
    base = work_dir(spark, "near-hot")
    rows = stored(rows.select("gram", "id", "root"), f"{base}/rows")
    by_hash = Window.partitionBy("gram").orderBy(F.xxhash64("id", F.lit(k)), "id")
    lead = rows.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= leaders)
    lead = stored(lead.groupBy("gram").agg(F.collect_list(F.struct(F.col("id").alias("v"), F.col("root").alias("other"))).alias("leads")), f"{base}/leaders")
    # a row meets all leaders of its cell at once, and a text's leaders are counted in one list
    others = F.transform(F.filter("leads", lambda x: x["other"] != F.col("root")), lambda x: x["v"])
    met = rows.join(lead, "gram").select("id", others.alias("met")).where(F.size("met") > 0)
    listed = met.groupBy("id").agg(F.flatten(F.collect_list("met")).alias("met"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [most_frequent(np.array(x.as_py(), np.int64), leaders) for x in b.column("met")]
            own, other = np.repeat(b.column("id").to_numpy(), np.array([len(x) for x in kept], np.int64)), np.concatenate([*kept, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.maximum(own, other)), pa.array(np.minimum(own, other))], names=["own", "u", "v"])

    out = stored(in_workers(listed, work, "own long, u long, v long"), work_dir(spark, "near-hot-pairs"))
    release(spark, base)
    return out


def candidates(found: DataFrame, sketches: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs u > v of ids that share a cell and may be similar enough; all that are, are among them."""
    spark = found.sparkSession
    found = found.join(stored(_short(sketches), sketch_path := work_dir(spark, "near-short")), "id")
    found = found.withColumn("before", F.lag("gram", 1).over(Window.partitionBy("id").orderBy("place")))
    found = found.withColumn("before", F.coalesce("before", "gram"))
    hot = found.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > cell_rows)
    hot = stored(hot.select("gram", F.ceil(F.col("m") / cell_rows).cast("int").alias("k")), hot_path := work_dir(spark, "near-hot"))
    columns = ("id", "n", "place", "root", "before", *WORDS)
    none = F.lit(0)
    if hot.isEmpty():
        dealt = found.select("gram", none.alias("x"), none.alias("y"), F.lit(2).alias("side"), *columns)
    else:
        # a cell of k blocks: a row of block b meets its own block in (b, b), larger ones in (b, y), smaller ones in (x, b)
        block = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
        both = found.join(hot, "gram", "left")
        other = both.where("k IS NOT NULL").withColumn("b", block).withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
        own = F.when(F.col("o") == F.col("b"), 2).when(F.col("o") > F.col("b"), 0).otherwise(1)
        dealt = both.where("k IS NULL").select("gram", none.alias("x"), none.alias("y"), F.lit(2).alias("side"), *columns)
        dealt = dealt.unionByName(other.select("gram", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), own.alias("side"), *columns))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = in_workers(dealt.repartition(parts, "gram", "x", "y").sortWithinPartitions("gram", "x", "y"), _met, "u long, v long")
    out = stored(met.distinct(), work_dir(spark, "near-pairs"))
    release(spark, hot_path, sketch_path)
    return out


def close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (u, v and others) that their long sketches leave open, and `bits`, in how many these differ."""
    columns = pairs.columns
    of = lambda end: sketches.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"of_{end}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([bits_apart(x.as_py(), y.as_py()) for x, y in zip(b.column("of_u"), b.column("of_v"), strict=True)], np.int64)
            near = may_differ(b.column("n_u").to_numpy().astype(np.int64), b.column("n_v").to_numpy().astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(bits)], names=[*columns, "bits"]).filter(pa.array(near))

    return in_workers(pairs.join(of("u"), "u").join(of("v"), "v"), work, ", ".join(f"{c} long" for c in [*columns, "bits"]))


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar enough, by their whole sets."""
    of = lambda end: docs.select(F.col("id").alias(end), F.col("text").alias(f"of_{end}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other = None, None
        for b in batches:
            near = []
            for v, x, y in zip(b.column("v"), b.column("of_u"), b.column("of_v"), strict=True):
                if v.as_py() != held:  # a leader's pairs stand together after a sorted join
                    held, other = v.as_py(), grams(y.as_py())
                own = grams(x.as_py())
                near.append((OVER + UNDER) * len(np.intersect1d(own, other, assume_unique=True)) >= OVER * (len(own) + len(other)))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return in_workers(pairs.join(of("u"), "u").join(of("v"), "v"), work, "u long, v long")


def groups(docs: DataFrame, cell_rows: int = CELL_ROWS, rounds: int = STAR_ROUNDS, hot_roots: int = HOT_ROOTS) -> DataFrame:
    """node, root: the smallest id that each id with a near copy is linked to. Of docs (id, text), ids unique."""
    spark = docs.sparkSession
    (found, sketches), links, base = cells(docs), None, work_dir(spark, "near-rounds")
    left, before, k = found.withColumn("root", F.col("id")), None, 0

    def linked(pairs: DataFrame) -> DataFrame:
        near = close(pairs, sketches)
        if "own" in pairs.columns:
            closest = Window.partitionBy("own").orderBy("bits", "u", "v")
            near = near.withColumn("at", F.row_number().over(closest)).where(F.col("at") <= CLOSEST)
        near = stored(near.select("u", "v").distinct(), f"{base}/close-{k}")
        release(spark)
        near = similar(near, docs)
        out = stored(near if links is None else links.unionByName(near), f"{base}/links-{k}")
        release(spark, f"{base}/close-{k}", f"{base}/links-{k - 1}")
        return out

    def still_open() -> DataFrame:
        """The rows of cells with two components or more."""
        roots = stored(components(links), f"{base}/roots-{k}")
        # cells that were closed once stay so: links only join components
        rows = left.drop("root")
        rooted = rows.join(roots, rows["id"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "id").alias("root"))
        rooted = stored(rooted, f"{base}/rooted-{k}")
        cells_left = rooted.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("gram")
        out = stored(rooted.join(stored(cells_left, f"{base}/open-{k}"), "gram"), f"{base}/left-{k}")
        release(spark, *(f"{base}/{x}-{k}" for x in ("roots", "rooted", "open")), f"{base}/left-{k - 1}")
        return out

    while k < rounds:
        links = linked(star(left, k))
        left, k = still_open(), k + 1
    while True:
        hot, now = hot_rows(left, hot_roots)
        if not now or before is not None and 10 * now > 9 * before:
            break
        links = linked(led(hot, k))
        left, k, before = still_open(), k + 1, now
    return components(linked(candidates(left, sketches, cell_rows)))


def one_of_each(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs, of each group of near copies the document with the smallest doc_id. doc_id is expected to be unique."""
    spark, own = docs.sparkSession, free_name(docs, "gone_")
    given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text"))
    with text_batches(spark):
        gone = stored(groups(given, cell_rows).where("node <> root").select(F.col("node").alias(own)).distinct(), work_dir(spark, "near-copies"))
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
