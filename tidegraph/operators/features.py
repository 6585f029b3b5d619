"""Node features of a stream and of daily snapshots, and their windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.columns import finite, ratio, sample_std

STREAM_FEATURES = "log_in_degree log_out_degree in_out_ratio log_unique_in log_unique_out log_total_btc_in log_total_btc_out log_avg_btc_in log_avg_btc_out recency activity_span log_event_rate burstiness out_entropy in_entropy".split()


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, other, outward, timestamp, sat. One scan feeds all features."""
    row = lambda node, other, out: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(out).alias("outward"))
    both = F.explode(F.array(row("src_idx", "dst_idx", 1), row("dst_idx", "src_idx", 0)))
    return edges.select(both.alias("e"), "timestamp", "sat").select("e.node", "e.other", "e.outward", "timestamp", "sat")


def node_features(edges: DataFrame) -> DataFrame:
    """node_idx and the 15 stream features: degrees, volumes, recency, rate, burstiness, counterparty entropy."""
    e = ends(edges)
    # counterparties first: the second step works on one row for each node, partner and direction
    by_pair = e.groupBy("node", "other", "outward").agg(F.count(F.lit(1)).alias("n"), F.sum("sat").alias("sat"))
    side = lambda out, c: F.when(F.col("outward") == out, c)
    sums = []
    for out, name in ((1, "out"), (0, "in")):
        sums += [
            F.coalesce(F.sum(side(out, F.col("n"))), F.lit(0)).alias(f"deg_{name}"),
            F.count(side(out, F.lit(1))).alias(f"uniq_{name}"),
            F.coalesce(F.sum(side(out, F.col("sat"))), F.lit(0)).alias(f"sat_{name}"),
            F.sum(side(out, F.col("n") * F.log("n"))).alias(f"nlogn_{name}"),
        ]
    degrees = by_pair.groupBy("node").agg(*sums)
    # H = ln N - sum(n ln n) / N, over its largest value ln(partners)
    entropy = lambda name: F.when(F.col(f"uniq_{name}") > 1, F.greatest(F.lit(0.0), (F.log(f"deg_{name}") - F.col(f"nlogn_{name}") / F.col(f"deg_{name}")) / F.log(f"uniq_{name}"))).otherwise(F.lit(0.0))
    order = Window.partitionBy("node").orderBy("timestamp")
    gaps = e.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(order))
    times = gaps.groupBy("node").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("events"), F.count("gap").alias("n_gaps"), F.avg("gap").alias("mu"), F.stddev_samp("gap").alias("sigma"))
    span = edges.agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    width = F.col("t1") - F.col("t0")
    own = F.col("last") - F.col("first")
    full = degrees.join(times, "node").crossJoin(F.broadcast(span))
    values = {
        "log_in_degree": F.log1p("deg_in"),
        "log_out_degree": F.log1p("deg_out"),
        "in_out_ratio": ratio(F.col("deg_out"), F.col("deg_in") + F.col("deg_out"), 0.5),
        "log_unique_in": F.log1p("uniq_in"),
        "log_unique_out": F.log1p("uniq_out"),
        "log_total_btc_in": F.log1p(F.col("sat_in") / 1e8),
        "log_total_btc_out": F.log1p(F.col("sat_out") / 1e8),
        "log_avg_btc_in": F.log1p(ratio(F.col("sat_in") / 1e8, F.col("deg_in"))),
        "log_avg_btc_out": F.log1p(ratio(F.col("sat_out") / 1e8, F.col("deg_out"))),
        "recency": ratio(F.col("t1") - F.col("last"), width),
        "activity_span": ratio(own, width),
        "log_event_rate": F.log1p(ratio(F.col("events"), own)),
        "burstiness": F.when(F.col("n_gaps") >= 2, (F.col("sigma") - F.col("mu")) / (F.col("sigma") + F.col("mu") + 1e-8)).otherwise(F.lit(0.0)),
        "out_entropy": entropy("out"),
        "in_entropy": entropy("in"),
    }
    return full.select(F.col("node").alias("node_idx"), *[F.round(finite(values[c].cast("double")), 6).alias(c) for c in STREAM_FEATURES])


#: The columns of daily_node_features(), in its order.
DAILY_FEATURES = [f"{a}_{b}" if a not in ("in", "out") else f"{a}_degree" for b in ("in", "out") for a in (b, "total_btc", "total_usd", "mean_btc", "median_btc", "max_btc", "min_btc", "std_btc", "unique")] + ["total_degree", "balance_btc", "balance_usd"]


def daily_node_features(daily: DataFrame) -> DataFrame:
    """date, node_idx and 21 daily aggregates in and out; sigma is the sample deviation, 0 for one edge."""
    row = lambda node, other, out: F.struct(F.col(node).alias("node_idx"), F.col(other).alias("other"), F.lit(out).alias("outward"))
    e = daily.select("date", F.explode(F.array(row("src_idx", "dst_idx", 1), row("dst_idx", "src_idx", 0))).alias("e"), "btc", "usd", "sat").select("date", "e.*", "btc", "usd", "sat")
    out = []
    for flag, name in ((0, "in"), (1, "out")):
        side = lambda c: F.when(F.col("outward") == flag, F.col(c))  # noqa: B023,E731
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        out += [
            F.count(side("btc")).alias(f"{name}_degree"),
            (F.coalesce(F.sum(side("sat")), F.lit(0)) / 1e8).alias(f"total_btc_{name}"),
            F.round(zero(F.sum(side("usd"))), 2).alias(f"total_usd_{name}"),
            F.round(zero(F.avg(side("btc"))), 10).alias(f"mean_btc_{name}"),
            F.round(zero(F.median(side("btc"))), 10).alias(f"median_btc_{name}"),
            zero(F.max(side("btc"))).alias(f"max_btc_{name}"),
            zero(F.min(side("btc"))).alias(f"min_btc_{name}"),
            F.round(sample_std(side("btc")), 6).alias(f"std_btc_{name}"),
            F.size(F.collect_set(side("other"))).cast("long").alias(f"unique_{name}"),  # distinct counts would make each row three
        ]
    # rows go out as they are: they are smaller than what sums, medians and sets of a few of them take
    f = e.repartition("date", "node_idx").groupBy("date", "node_idx").agg(*out)
    return f.withColumns({
        "total_degree": F.col("in_degree") + F.col("out_degree"),
        "balance_btc": F.round(F.col("total_btc_in") - F.col("total_btc_out"), 8),
        "balance_usd": F.round(F.col("total_usd_in") - F.col("total_usd_out"), 2),
    })


def gini(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Gini coefficient of a value in each group; 0 where the sum is 0. Equal values are counted before they are sorted."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the ranks of c equal values add up to this
    ranks = F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2
    summed = counted.withColumn("ranks", ranks).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col(value) * F.col("c")).alias("total"), F.sum(F.col("ranks") * F.col(value)).alias("top"))
    n, total = F.col("n"), F.col("total")
    return summed.select(*by, F.when(total > 0, 2 * F.col("top") / (n * total) - (n + 1) / n).otherwise(F.lit(0.0)).alias("gini"))


def daily_graph_features(daily: DataFrame) -> DataFrame:
    """A row of graph features a day: size, density, degrees, reciprocity, assortativity, inequality."""
    pairs = daily.groupBy("date", "src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("n"))
    out = daily.groupBy("date", F.col("src_idx").alias("node")).agg(F.count(F.lit(1)).alias("o")).withColumn("i", F.lit(0))
    into = daily.groupBy("date", F.col("dst_idx").alias("node")).agg(F.count(F.lit(1)).alias("i")).withColumn("o", F.lit(0))
    deg = out.unionByName(into).groupBy("date", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).withColumn("d", F.col("o") + F.col("i"))
    degrees = deg.groupBy("date").agg(F.count(F.lit(1)).alias("num_nodes"), F.avg("d").alias("mean_degree"), F.median("d").alias("median_degree"), F.max("d").alias("max_degree"), F.stddev_pop("d").alias("std_degree"))
    sums = daily.groupBy("date").agg(F.count(F.lit(1)).alias("num_edges"), (F.sum("sat") / 1e8).alias("total_btc"))
    back = pairs.select("date", F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), F.lit(1).alias("back"))
    mutual = pairs.where("src_idx <> dst_idx").join(back, ["date", "src_idx", "dst_idx"], "left").groupBy("date").agg((F.count("back") / F.count(F.lit(1))).alias("reciprocity"))
    s = deg.select("date", F.col("node").alias("src_idx"), F.col("o").cast("double").alias("x"))
    t = deg.select("date", F.col("node").alias("dst_idx"), F.col("i").cast("double").alias("y"))
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("y")
    # exact sums of whole numbers; a constant side has no correlation
    top = n * F.sum(F.col("x") * F.col("y")) - sx * sy
    vx, vy = n * F.sum(F.col("x") * F.col("x")) - sx * sx, n * F.sum(F.col("y") * F.col("y")) - sy * sy
    mixing = daily.join(s, ["date", "src_idx"]).join(t, ["date", "dst_idx"]).groupBy("date").agg(F.when((n > 1) & (vx > 0) & (vy > 0), top / (F.sqrt(vx) * F.sqrt(vy))).otherwise(F.lit(0.0)).alias("assortativity"))
    parts = [sums, degrees, mutual, mixing, gini(deg, "d", ["date"]).withColumnRenamed("gini", "gini_degree")]
    full = reduce(lambda a, b: a.join(b, "date", "left"), parts)
    density = F.when(F.col("num_nodes") > 1, F.col("num_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))).otherwise(F.lit(0.0))
    r = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return full.select("date", "num_edges", "num_nodes", "total_btc", F.round(density, 6).alias("density"), r("mean_degree"), r("median_degree"), "max_degree", r("std_degree"), r("reciprocity"), r("assortativity"), r("gini_degree"))


def days_numbered(daily: DataFrame) -> DataFrame:
    """date, day_idx from 0."""
    from tidegraph.functions.ordering import numbered

    return numbered(daily.select("date").distinct(), ["date"], "day_idx")


def window_features(features: DataFrame, value: str, window: int, decay: float | None = None) -> DataFrame:
    """For each node and day on which it appears: the mean of a value over the `window` days before.

    With decay, days weigh exp(-decay * days back); only days on which the node appears count.
    """
    w = Window.partitionBy("node_idx").orderBy("day_idx").rangeBetween(-window, -1)
    if decay is None:
        return features.withColumn("mean", F.avg(value).over(w))
    # exp(-k (t - i)) = exp(k i) / exp(k t): relative to each row the factors stay small
    past = F.collect_list(F.struct("day_idx", F.col(value).alias("v"))).over(w)
    weight = lambda x: F.exp(-F.lit(decay) * (F.col("day_idx") - x["day_idx"]))
    held = features.withColumn("__past", past)
    top = F.aggregate("__past", F.lit(0.0), lambda a, x: a + weight(x) * x["v"])
    low = F.aggregate("__past", F.lit(0.0), lambda a, x: a + weight(x))
    return held.withColumn("mean", F.when(F.size("__past") > 0, top / low)).drop("__past")


def correlations(features: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """a, b, r of each pair of columns with |r| of at least `least`; constant columns have none. One pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = features.agg(*[F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]))
    return one.select(rows.alias("x")).select("x.*").where(F.col("r").isNotNull() & (F.abs("r") >= least))
