"""Slices and splits of a stream, by time and by position."""

from __future__ import annotations

import math
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seconds(day: str) -> int:
    d = date.fromisoformat(day)
    return int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp())


def date_range(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Whole UTC days from start to end, both included."""
    after = seconds((date.fromisoformat(end) + timedelta(days=1)).isoformat())
    return edges.where(F.col("timestamp").between(seconds(start), after - 1))


def prefix(edges: DataFrame, fraction: float) -> DataFrame:
    """The first int(n * fraction) rows in time order."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return edges.where(F.col("edge_seq") < math.floor(edges.count() * fraction))


def chronological(edges: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """edges with split: train, val or test, by position among all rows."""
    n = edges.count()
    a, b = math.floor(n * train), math.floor(n * (train + val))
    if not 0 < a < b < n:
        raise ValueError("a split would be empty")
    return edges.withColumn("split", F.when(F.col("edge_seq") < a, "train").when(F.col("edge_seq") < b, "val").otherwise("test"))


def day_windows(daily: DataFrame, window: int, offset: int = 0) -> DataFrame:
    """daily (with date) with split: `window` days of train, the next of val, the next of test; counted from the end."""
    from tidegraph.functions.ordering import numbered

    days = numbered(daily.select("date").distinct(), ["date"], "day_idx")
    last = (days.agg(F.max("day_idx")).first()[0] or 0) - offset
    split = F.when(F.col("day_idx") == last, "test").when(F.col("day_idx") == last - 1, "val").when(F.col("day_idx").between(last - 1 - window, last - 2), "train")
    return daily.join(days, "date").withColumn("split", split).where("split IS NOT NULL")


def known_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among nodes (node)."""
    a = nodes.select(F.col("node").alias("src_idx"))
    b = nodes.select(F.col("node").alias("dst_idx"))
    return edges.join(a, "src_idx", "left_semi").join(b, "dst_idx", "left_semi")


def nodes_of(edges: DataFrame) -> DataFrame:
    """node: every distinct end."""
    return edges.select(F.col("src_idx").alias("node")).unionByName(edges.select(F.col("dst_idx").alias("node"))).distinct()


def with_reverse(edges: DataFrame) -> DataFrame:
    """Each edge forward (dir 0) and reversed (dir 1)."""
    back = edges.withColumns({"src_idx": F.col("dst_idx"), "dst_idx": F.col("src_idx")})
    return edges.withColumn("dir", F.lit(0)).unionByName(back.withColumn("dir", F.lit(1)))
