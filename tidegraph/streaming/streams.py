"""Structured Streaming forms of the time-ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegraph.plans.storage import work_dir


def daily_windows(stream: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total: tumbling or sliding windows of events; later rows than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, session_start, n: runs of events with gaps below `gap`."""
    s = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), "n")


def partners(stream: DataFrame, keep: int = 3) -> DataFrame:
    """user_id, event_id, past: each event with the latest `keep` partners of its user before it; state holds those only."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for rows in (pd.concat(list(batches)).sort_values(["ts", "event_id"]),):
            out = []
            for event, partner in zip(rows["event_id"], rows["partner"], strict=True):
                out.append((key[0], event, ",".join(map(str, past))))
                past = [*past, int(partner)][-keep:]
            yield pd.DataFrame(out, columns=["user_id", "event_id", "past"])
        state.update((past,))

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, past string", "past array<long>", "append", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The events table as a stream, with its partner number from props."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    partner = F.get_json_object("props", "$.k").cast("long")
    # the last letter as a pattern: a lone file is no base folder for a stream
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("partner", partner)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to parquet by an availableNow run that could go on from its checkpoint.

    In complete mode each micro-batch holds the whole result, so the last one is what is read.
    """
    spark = stream.sparkSession
    base, numbers = work_dir(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/batch={max(numbers)}" if mode == "complete" else f"{base}/rows/*")
