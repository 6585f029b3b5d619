"""Aggregates over a whole stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.selection import nodes_of


def stream_report(edges: DataFrame) -> DataFrame:
    """One row of counts, ranges, amounts, degrees over distinct pairs, and density. Zeros and nulls when empty."""
    total = edges.agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.countDistinct("src_idx").alias("unique_sources"),
        F.countDistinct("dst_idx").alias("unique_destinations"),
        F.min("timestamp").alias("timestamp_min"),
        F.max("timestamp").alias("timestamp_max"),
        F.coalesce(F.sum("sat"), F.lit(0)).alias("sat"),
        F.median("sat").alias("median_sat"),
        F.max("sat").alias("max_sat"),
        F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 2).alias("total_usd"),
        F.coalesce(F.sum((F.col("src_idx") == F.col("dst_idx")).cast("long")), F.lit(0)).alias("self_loops"),
    )
    nodes = nodes_of(edges).agg(F.count(F.lit(1)).alias("num_nodes"))
    pairs = edges.select("src_idx", "dst_idx").distinct()
    degrees = lambda end, name: pairs.groupBy(end).count().agg(F.avg("count").alias(f"mean_{name}_degree"), F.median("count").alias(f"median_{name}_degree"), F.max("count").alias(f"max_{name}_degree"), F.coalesce(F.sum("count"), F.lit(0)).alias(f"{name}_pairs"))
    # each of the four is one row
    one = total.crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(degrees("src_idx", "out"))).crossJoin(F.broadcast(degrees("dst_idx", "in")))
    n = F.col("num_nodes")
    return one.select(
        "num_edges", "num_nodes", "unique_sources", "unique_destinations", "timestamp_min", "timestamp_max",
        (F.col("sat") / 1e8).alias("total_btc"), "total_usd",
        F.when(F.col("num_edges") > 0, F.col("sat") / F.col("num_edges") / 1e8).alias("mean_btc"),
        (F.col("median_sat") / 1e8).alias("median_btc"), (F.col("max_sat") / 1e8).alias("max_btc"),
        F.col("out_pairs").alias("unique_directed_edges"), (F.col("num_edges") - F.col("out_pairs")).alias("repeated_pair_events"), "self_loops",
        "mean_out_degree", "median_out_degree", "max_out_degree", "mean_in_degree", "median_in_degree", "max_in_degree",
        F.when(n > 1, F.col("out_pairs") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density_directed"),
    )


def raw_profile(raw: DataFrame) -> DataFrame:
    """What a raw table holds before it is cleaned."""
    flag = lambda c: F.sum(c.cast("long"))
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("SRC_ID").alias("n_src"), F.countDistinct("DST_ID").alias("n_dst"),
        flag((F.col("SRC_ID") == 0) | (F.col("DST_ID") == 0)).alias("entity_zero"), flag(F.col("SRC_ID") == F.col("DST_ID")).alias("self_loops"),
        F.min("VALUE_SATOSHI").alias("min_sat"), F.max("VALUE_SATOSHI").alias("max_sat"), F.sum("VALUE_SATOSHI").alias("sum_sat"),
    )


def daily(edges: DataFrame) -> DataFrame:
    return edges.withColumn("date", F.to_date(F.timestamp_seconds("timestamp")))


def daily_stats(edges: DataFrame) -> DataFrame:
    """date, edges, nodes, pairs and amounts of each day."""
    d = daily(edges)
    nodes = d.select("date", F.explode(F.array("src_idx", "dst_idx")).alias("node")).groupBy("date").agg(F.countDistinct("node").alias("num_nodes"))
    pairs = d.groupBy("date").agg(F.count(F.lit(1)).alias("num_edges"), F.countDistinct("src_idx", "dst_idx").alias("num_pairs"), (F.sum("sat") / 1e8).alias("total_btc"), F.round(F.sum("usd"), 2).alias("total_usd"))
    return pairs.join(nodes, "date")


def pair_rollup(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("event_count"), (F.sum("sat") / 1e8).alias("total_btc"), F.round(F.sum("usd"), 2).alias("total_usd"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_idx").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def hourly_activity(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, ts: str = "ts", width: str = "30 minutes") -> DataFrame:
    w = events.groupBy(F.window(F.col(ts).cast("timestamp"), width)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "n")


def value_histogram(edges: DataFrame, bins: int = 80) -> DataFrame:
    """Equal-width bins of log10(btc + 1e-10), from the least to the largest value; the largest is in the last bin."""
    x = edges.select(F.round(F.log10(F.col("btc") + 1e-10), 9).alias("x"))
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width))).cast("long")
    return x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entity_overlap(edges: DataFrame, first: str, second: str) -> DataFrame:
    """How many nodes are seen on both of two days, only the first, only the second."""
    d = daily(edges).select("date", F.explode(F.array("src_idx", "dst_idx")).alias("node"))
    seen = d.where(F.col("date").isin(first, second)).groupBy("node").agg(F.max((F.col("date") == first).cast("int")).alias("a"), F.max((F.col("date") == second).cast("int")).alias("b"))
    return seen.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_first"), F.sum((1 - F.col("a")) * F.col("b")).alias("only_second"))


def top_nodes(edges: DataFrame, k: int = 30) -> DataFrame:
    """The k nodes with the most incident events; ties go to smaller ids."""
    ends = edges.select(F.col("src_idx").alias("node")).unionByName(edges.select(F.col("dst_idx").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "node").limit(k)


def top_subgraph(edges: DataFrame, k: int = 30) -> DataFrame:
    """Pairs between the top nodes, rolled up."""
    top = top_nodes(edges, k).select("node")
    inner = edges.join(F.broadcast(top.withColumnRenamed("node", "src_idx")), "src_idx", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "dst_idx")), "dst_idx", "left_semi")
    return inner.groupBy("src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("event_count"))


def hub_links(edges: DataFrame, max_nodes: int = 40, max_edges: int = 60) -> DataFrame:
    """The busiest node and its most frequent links: some of each direction, then the most frequent of the rest, inbound first.

    Of each direction only the max_nodes - 1 most frequent links can take part, so the choice is made among few rows.
    """
    slots = max(0, max_nodes - 1)
    cap = max(1, min(max_edges // 2, slots // 2, 10))
    hub = top_nodes(edges, 1).select(F.col("node").alias("hub"))
    pairs = pair_rollup(edges).where("src_idx <> dst_idx").crossJoin(F.broadcast(hub))
    links = lambda near, far, name: pairs.where(F.col(near) == F.col("hub")).orderBy(F.desc("event_count"), far).limit(slots).select("hub", F.lit(name).alias("direction"), "src_idx", "dst_idx", "event_count", F.col(far).alias("other"))
    both = links("src_idx", "dst_idx", "out").unionByName(links("dst_idx", "src_idx", "in"))
    ranked = both.withColumn("later", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("event_count"), "other")) > cap)
    kept = ranked.orderBy("later", F.desc("event_count"), "direction", "other").limit(slots)
    return kept.orderBy(F.desc("event_count"), "src_idx", "dst_idx").limit(max_edges).select("hub", "direction", "src_idx", "dst_idx", "event_count")


def format_report(row) -> str:
    """A report row as text."""
    return "\n".join(f"{k.replace('_', ' '):>24}: {v if v is not None else '-'}" for k, v in row.asDict().items())
