"""Exact deduplication as a stateful stream.

Every document arrives as (digest, doc_id, locator). A streaming aggregation keyed by digest keeps, in RocksDB
state without expiry, the identifier and locator of the copy that stays and the number of copies. Digests seen more
than once are hits: the full bytes of their documents are compared before anything is dropped. DataFrame
operations only.

Scale: the state holds one small row per distinct text and is spread by digest; map-side combining means that a
text with a third of all rows costs one row per task. A micro-batch reads batch_bytes of arrivals. Whole texts are
shuffled once, for the byte check. Joins on the digest salt the rows of groups with over a thousandth of all rows, under
a thousand in number, so that no task gets all rows of one of them; the other side holds each such group once a salt,
and one text a salt is compared across salts.

Defined results: a null text is the empty text; equal texts are those identical after lower-casing A-Z; the row
with the largest doc_id stays (null ids sort below all others; among rows with equal doc_id and text the one with
the largest locator stays, so exactly one row of a group is kept). An empty table gives an empty result. Other
columns of the input are ignored; only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.llm.common import ascii_lower, file_locator, free_name, release, settings, stored, text_of, work_dir

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store leaves the executor's disk when its task has committed to the shared checkpoint
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: A group with more rows than this share of all, and than HOT_ROWS, is hot; under HOT_GROUPS groups can be.
HOT_GROUPS, HOT_ROWS = 1000, 64
#: Arrivals that one micro-batch reads.
BATCH_BYTES = 16 << 30


def sha256(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def keyed_state(spark: SparkSession, arrivals: str, state: str, schema, batch_bytes: int = BATCH_BYTES) -> None:
    """Bring the state in `state` up to date with the files in `arrivals`.

    Called again after more files have arrived, it goes on from its checkpoint and reads only the new ones; each
    micro-batch writes the rows that it changed to `state`/changes, under its own number, so a repeated batch
    overwrites itself.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/changes/batch={number}")

    with settings(spark, ROCKSDB):
        groups = (
            spark.readStream.schema(schema)
            .option("maxBytesPerTrigger", str(batch_bytes))
            .parquet(arrivals)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("copies"))
        )
        query = groups.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state}/checkpoint").foreachBatch(keep).start()
        query.awaitTermination()


def read_state(spark: SparkSession, state: str, schema) -> DataFrame:
    """Digest, keeper, copies. Both only grow, so the latest change of a digest is its largest."""
    changes = spark.read.schema(schema).parquet(f"{state}/changes/*")
    return changes.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("copies").alias("copies"))


def exact_groups(docs: DataFrame, locator: Column | None = None, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, locator, keep_id, group_size, kept, digest.

    `locator` tells rows apart; by default file and row number, for frames read straight from files.
    """
    spark = docs.sparkSession
    base = work_dir(spark, "exact-dedup")
    norm = ascii_lower(text_of(docs))
    located = docs.select("doc_id", (file_locator() if locator is None else locator).alias("locator"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    arrivals = stored(located.select("doc_id", "locator", "digest"), f"{base}/arrivals")
    if arrivals.isEmpty():
        return arrivals.select("doc_id", "locator", F.lit(None).cast(arrivals.schema["doc_id"].dataType).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), "digest")
    keyed_state(spark, f"{base}/arrivals", f"{base}/state", arrivals.schema, batch_bytes)
    group_schema = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("copies")).schema
    state = read_state(spark, f"{base}/state", group_schema)

    least = max(arrivals.count() // HOT_GROUPS, HOT_ROWS)
    parts = F.ceil(F.col("copies") / least)
    # fewer than HOT_GROUPS narrow rows, which is a proven bound for the broadcast
    hot = stored(state.where(F.col("copies") > least).select("digest", parts.alias("parts")), f"{base}/hot")

    def salted(rows: DataFrame) -> DataFrame:
        salt = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("locator"), "parts")).cast("long")
        return rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).drop("parts")

    def once_a_salt(groups: DataFrame) -> DataFrame:
        return groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))

    # hits: the full bytes decide; equal digests are neighbours after the join, so each text is held against the one before
    hits = once_a_salt(state.where("copies > 1").select("digest", "copies"))
    in_salt = W.partitionBy("digest", "salt").orderBy("digest")
    held = salted(located).join(hits, ["digest", "salt"]).select("digest", "salt", "copies", "norm", F.lag("norm").over(in_salt).alias("before"))
    told = held.where("before IS NULL OR before <> norm").select("digest", "salt", F.when((F.col("copies") > least) & F.col("before").isNull(), F.col("norm")).alias("norm"), F.col("before").isNotNull().alias("differs"))
    told = stored(told.where("differs OR norm IS NOT NULL"), f"{base}/checked")  # one text a salt of a hot group, and what differs
    across = told.where("NOT differs").select("digest", (F.col("norm") != F.lag("norm").over(W.partitionBy("digest").orderBy("salt"))).alias("differs"))
    clash = stored(told.where("differs").select("digest").unionByName(across.where("differs").select("digest")).distinct(), f"{base}/clash")
    shape = lambda d: d.select("doc_id", "locator", F.col("keeper.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), (F.struct("doc_id", "locator").eqNullSafe(F.col("keeper"))).alias("kept"), "digest")
    in_groups = lambda rows: shape(salted(rows).join(once_a_salt(state), ["digest", "salt"]))
    if clash.isEmpty():
        out = in_groups(arrivals)
    else:  # different texts under one digest: those rows are grouped by their bytes
        odd = stored(located.join(clash, "digest", "left_semi"), f"{base}/odd")
        by_text = odd.groupBy("norm").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("copies"))
        out = in_groups(arrivals.join(clash, "digest", "left_anti")).unionByName(shape(odd.join(by_text, "norm")))
    out = stored(out, f"{base}/out")
    release(spark, *(f"{base}/{x}" for x in ("arrivals", "state", "checked", "clash", "odd", "hot")))
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, one row of each group of equal texts. docs are read straight from files."""
    own = free_name(docs, "locator_")
    kept = exact_groups(docs).where("kept").select(F.col("locator").alias(own))
    return docs.withColumn(own, file_locator()).join(kept, own, "left_semi").drop(own)
