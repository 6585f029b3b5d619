"""Hierarchical best-fit packing of tokenised documents into sequences.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Each task packs its pieces by
best fit, longest first. Bins that are nearly full are done. Underfull bins go up a tree as items: groups of tasks
merge theirs by best fit, round after round, until one group is left.

What goes up is bounded. After best fit no two bins of a task fit together, so at most one of them is half full or
less. Only that one can still go into another bin, and it needs one receiver: a task sends it, and its `fan_in`
emptiest other bins as receivers for the small bins of its siblings. All other bins are final where they are.

Scale: pieces are written once as narrow rows (no tokens); the tree handles at most 1 + fan_in rows a task; final
places come from one join on the bin. The tokenizer is applied word by word with a bounded memo in each worker;
texts outside Latin-1, and any with special tokens, go to the tokenizer whole.

Defined results: a null text is empty, and an empty document is the single closing id; repeated rows are packed
once each; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_workers, release, stored, text_batches, text_of, work_dir

CAPACITY, END_ID, FAN_IN = 4096, 1, 16
#: A bin this full is done.
NEARLY_FULL = 0.995
#: Pieces packed at once in a task; bounds its memory.
WINDOW = 200_000
#: Words remembered in a task; half as many parts of words.
MEMO_WORDS = 200_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


class Memo:
    """Two generations of a dict: what has not been asked for since the last change is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """The keys not held; the others are all in `new` afterwards."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out = []
        for k in dict.fromkeys(keys):
            if k not in self.new:
                if k in self.old:
                    self.new[k] = self.old[k]
                else:
                    out.append(k)
        return out


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own, with a memo of words.

    The tokenizer lower-cases, splits into contractions, letter runs, single numbers and runs of other marks, never
    across white space, and encodes each part by itself. So words can be remembered, and the parts of new words. That
    split is repeated here for Latin-1 only.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parts_only = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts_only.normalizer = None
        self.parts_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo = memo
        self.forget()
        letters, numbers = _class("L"), _class("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall

    def forget(self) -> None:
        self.words, self.parts = Memo(self.memo), Memo(self.memo // 2)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        new = {w: self.split(w) for w in self.words.missing(words)}
        parts = self.parts.missing(p for own in new.values() for p in own)
        for k in range(0, len(parts), 256):
            some = parts[k : k + 256]
            ids = np.array(self.parts_only.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            data = ids.tobytes()
            for p, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.parts.new[p] = data[a:b]
        for w, own in new.items():
            self.words.new[w] = b"".join([self.parts.new[p] for p in own])

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        # control characters and odd white space go to the tokenizer, as do its special tokens
        if "<|" in text or not text.replace("\n", " ").replace("\t", " ").isprintable():
            return self.whole(text)
        words = text.lower().split()
        try:
            return b"".join(map(self.words.new.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.words.new.__getitem__, words))


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker, kept over its tasks; what it remembers is not."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class BestFit:
    """Bins by free room; the least room that still holds an item wins, among equals the bin that was opened last."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free, self.rooms = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, number: int, room: int) -> None:
        self.rooms[room].append(number)
        self.free |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fit = self.free >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        number = self.rooms[room].pop()
        if not self.rooms[room]:
            self.free ^= 1 << room
        return number, room


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its offset there, and how full each bin is. Longest first."""
    bins, offsets, used, fit = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], BestFit(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if found := fit.take(size):
            number, room = found
        else:
            number, room = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = number, capacity - room
        used[number] += size
        if room > size:
            fit.add(number, room - size)
    return bins, offsets, np.array(used, np.int64)


PIECES = "piece int, start long, length long, ids_crc32 long, bin long, place long, used long"


def _pieces(path: str, capacity: int, end_id: int, window: int, id_type: pa.DataType):
    end = end_id.to_bytes(4, "little")

    def packed(rows: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([r[3] for r in rows], np.int64)
        bins, places, used = best_fit(sizes, capacity)
        for k in range(0, len(rows), 10_000):
            some = slice(k, k + 10_000)
            ids, piece, start, length, crc = zip(*rows[some], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(bins[some] + first), pa.array(places[some]), pa.array(used[bins[some]])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "used"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, rows, first = word_ids(path), [], TaskContext.get().partitionId() << 40
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = ids_of(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= window:
                yield from packed(rows, first)
                first, rows = first + len(rows), []
        ids_of.forget()
        if rows:
            yield from packed(rows, first)

    return work


def _merge(capacity: int, fan_in: int, full: int):
    """Bins of one group (bin, members with their shifts, used) packed as items; state: whether a bin is done."""

    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["used", "bin"], ascending=[False, True], ignore_index=True)
        bins, places, used = best_fit(pdf["used"].to_numpy(), capacity)
        members: list[list] = [[] for _ in used]
        names: list[int] = [-1] * len(used)
        for k, (name, own) in enumerate(zip(pdf["bin"], pdf["members"], strict=True)):
            if not members[bins[k]]:
                names[bins[k]] = name
            members[bins[k]] += [{"bin": int(m["bin"]), "shift": int(m["shift"]) + int(places[k])} for m in own]
        up = carried(used, capacity, fan_in, full)
        return pd.DataFrame({"node": pdf["parent"].iloc[0], "bin": names, "members": members, "used": used, "done": ~up})

    return work


def carried(used: np.ndarray, capacity: int, fan_in: int, full: int) -> np.ndarray:
    """Which bins go up: those half full or less, and the fan_in emptiest of the rest that aren't nearly full."""
    up = used * 2 <= capacity
    rest = np.flatnonzero(~up & (used < full))
    up[rest[np.argsort(used[rest], kind="stable")[:fan_in]]] = True
    return up


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = FAN_IN, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    spark = docs.sparkSession
    base, full = work_dir(spark, "packing"), int(capacity * NEARLY_FULL)
    given = docs.select("doc_id", text_of(docs).alias("text"))
    id_type = spark_to_arrow(given.schema["doc_id"].dataType)
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {PIECES}"
    with text_batches(spark):
        pieces = stored(in_workers(given, _pieces(tokenizer, capacity, end_id, window, id_type), schema), f"{base}/pieces")

    bins = pieces.where("place = 0").select(F.shiftright("bin", 40).alias("node"), "bin", "used")
    # the same choice as carried(), for the first level: ranks within a task's few underfull bins
    from pyspark.sql import Window as W

    small = F.col("used") * 2 <= capacity
    ranked = bins.where(F.col("used") < full).withColumn("rank", F.row_number().over(W.partitionBy("node", small).orderBy("used", "bin")))
    up = ranked.where(small | (F.col("rank") <= fan_in))
    level = stored(up.select("node", "bin", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"), "used", F.lit(False).alias("done")), f"{base}/level-0")
    k, tables = 0, [f"{base}/level-0"]
    moved = None
    while True:
        k += 1
        grouped = level.where("NOT done").withColumn("parent", F.floor(F.col("node") / fan_in).cast("long"))
        level = stored(grouped.groupBy("parent").applyInPandas(_merge(capacity, fan_in, full), level.schema), f"{base}/level-{k}")
        tables.append(f"{base}/level-{k}")
        last = level.agg(F.max("node")).first()[0]
        done = level if not last else level.where("done")
        moved = done if moved is None else moved.unionByName(done)
        if not last:
            break
    places = moved.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
    out = pieces.join(places, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))
    out = stored(out, f"{base}/out")
    release(spark, f"{base}/pieces", *tables)
    return out


def spark_to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
