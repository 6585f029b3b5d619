"""The registered queries of the graph operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.columns import signed_log1p, time_encoding
from tidegraph.functions.ordering import numbered
from tidegraph.operators import candidates, daily, features, forecast, graph, learn, pairs, ranking, report, selection, temporal
from tidegraph.plans.storage import stored
from tidegraph.sources import tables
from tidegraph.sources.tables import payment_stream, payments, raw_transactions, table
from tidegraph.streaming import streams

NEGATIVES, NEIGHBOURS, PARTNERS = 20, 20, 4


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stream_report(payments(spark, sf_dir))


def raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.raw_profile(raw_transactions(spark, sf_dir))


def entity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.entity_mapping(tables.both_ends(raw_transactions(spark, sf_dir), "SRC_ID", "DST_ID", "entity_id"))


def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = payments(spark, sf_dir)
    mapping = tables.entity_mapping(tables.both_ends(raw_transactions(spark, sf_dir), "SRC_ID", "DST_ID", "entity_id"))
    return tables.mapped(edges, mapping).groupBy("src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("sat").alias("sat"))


def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir).select("src_idx", "dst_idx", "timestamp", "btc", "usd")


def edge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_stream(spark, sf_dir).select("edge_seq", "timestamp", "src_idx", "dst_idx", "sat")


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bipartite(payments(spark, sf_dir)).select("src_idx", "dst_idx", "timestamp", "sat")


def dense_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = tables.dense_remap(payments(spark, sf_dir).select("src_idx", "dst_idx"))
    return edges.groupBy("src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("n"))


def dense_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(payment_stream(spark, sf_dir))
    few, nodes = tables.dense_bundle(edges, features.node_features(edges), 1000)
    ends = few.select("edge_seq", "src_idx", "dst_idx")
    return ends.join(nodes.withColumnRenamed("node_idx", "src_idx"), "src_idx", "left").select("edge_seq", "src_idx", "dst_idx", *features.STREAM_FEATURES)


def date_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.date_range(payments(spark, sf_dir), "1996-01-01", "1996-03-31").select("src_idx", "dst_idx", "timestamp", "sat")


def prefix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.prefix(stored(payment_stream(spark, sf_dir)), 0.1).select("edge_seq", "timestamp", "sat")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = selection.chronological(stored(payment_stream(spark, sf_dir)))
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sum("sat").alias("sat"))


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = selection.day_windows(stored(report.daily(payments(spark, sf_dir)).select("date", "sat")), 7)
    return _dated(split.groupBy("date", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("sat").alias("sat")))


def known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stored(selection.chronological(stored(payment_stream(spark, sf_dir))))
    nodes = selection.nodes_of(split.where("split = 'train'"))
    return selection.known_only(split.where("split <> 'train'"), nodes).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("sat").alias("sat"))


def undirected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = selection.with_reverse(stored(payment_stream(spark, sf_dir)))
    return numbered(both.select("timestamp", "dir", "edge_seq", "src_idx", "dst_idx"), ["timestamp", "dir", "edge_seq"], "pos").select("pos", "dir", "src_idx", "dst_idx")


def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(report.daily_stats(payments(spark, sf_dir)))


def pair_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pair_rollup(payments(spark, sf_dir))


def neighbor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = payments(spark, sf_dir).groupBy(F.col("src_idx").alias("node")).agg(F.array_sort(F.collect_set("dst_idx")).alias("s"))
    return edges.select("node", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("neighbors"))


def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.nodes_of(payments(spark, sf_dir))


def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.degree_histogram(payments(spark, sf_dir))


def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.hourly_activity(table(spark, sf_dir, "events"))


def tumbling_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tumbling(table(spark, sf_dir, "events"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.value_histogram(payments(spark, sf_dir))


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.entity_overlap(payments(spark, sf_dir), "1996-01-02", "1996-01-03")


def topk_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_subgraph(payments(spark, sf_dir), 30)


def hub_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.hub_links(payments(spark, sf_dir))


def value_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(signed_log1p(F.col("value")), 6).alias("slog"), F.round(F.log1p(F.greatest(F.col("value"), F.lit(0.0))), 6).alias("log"))


def time_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400).cast("double").alias("t"))
    enc = time_encoding(F.col("t"), 4)
    return e.select("event_id", *[F.round(F.get(enc, k), 6).alias(f"e{k}") for k in range(4)])


def node_features_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.node_features(stored(payments(spark, sf_dir)))


def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored(features.node_features(stored(payments(spark, sf_dir))))
    return features.correlations(f, features.STREAM_FEATURES).select("a", "b", F.round("r", 4).alias("r"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(report.daily(payments(spark, sf_dir)))


def daily_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(features.daily_node_features(report.daily(payments(spark, sf_dir))))  # read once, so not stored


def daily_graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(features.daily_graph_features(_daily(spark, sf_dir)))


def _node_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    days = features.days_numbered(d)
    return stored(d.groupBy("date", F.col("src_idx").alias("node_idx")).agg(F.sum("sat").cast("double").alias("x")).join(days, "date"))


def window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(_node_days(spark, sf_dir), "x", 30).select("node_idx", "day_idx", F.round("mean", 2).alias("mean"))


def window_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(_node_days(spark, sf_dir), "x", 30, 0.1).select("node_idx", "day_idx", F.round("mean", 2).alias("mean"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(payments(spark, sf_dir)).withColumn("clustering", F.round("clustering", 6))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(payments(spark, sf_dir), rounds=5, tolerance=None).select("node", F.round("rank", 8).alias("rank"))


def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(payments(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(payments(spark, sf_dir))


def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.core_numbers(payments(spark, sf_dir))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(graph.daily_strong_components(_daily(spark, sf_dir)))


def daily_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(daily.topology(_daily(spark, sf_dir))).withColumn("clustering", F.round("clustering", 6))


def daily_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    return _dated(daily.structure(stored(daily.topology(d)), stored(graph.daily_strong_components(d))))


def daily_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(daily.daily_pagerank(_daily(spark, sf_dir), rounds=5, tolerance=None)).withColumn("rank", F.round("rank", 8))


def daily_pagerank_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unequal the nodes of a day are by PageRank."""
    ranked = stored(daily_pagerank(spark, sf_dir))
    return features.gini(ranked, "rank", ["date"]).select("date", F.round(F.col("gini") + 1e-9, 6).alias("gini"))  # no ties


def daily_pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(daily.daily_pagerank(_daily(spark, sf_dir))).withColumn("rank", F.round("rank", 8))


def daily_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(daily.heuristic_days(_daily(spark, sf_dir)))


def heuristics_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.over_days(stored(daily.heuristic_days(_daily(spark, sf_dir))))


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.snapshot_events(_daily(spark, sf_dir)).select("pos", "timestamp", "dir", "src_idx", "dst_idx", "sat")


def mean_daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = daily.mean_features(report.daily(payments(spark, sf_dir)), features.DAILY_FEATURES)
    return means.select("node_idx", "days", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in features.DAILY_FEATURES])  # no ties


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All pairs of a source and a destination of the last 15 % of the stream, and all edges before."""
    split = stored(selection.chronological(stored(payment_stream(spark, sf_dir))))
    asked = split.where("split = 'test'").select(F.col("src_idx").alias("a"), F.col("dst_idx").alias("b")).distinct()
    return stored(asked), split.where("split = 'train'")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.scores(*_asked(spark, sf_dir))


def pair_features_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.features_7(*_asked(spark, sf_dir))


def pair_features_34(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, train = _asked(spark, sf_dir)
    nodes = stored(features.node_features(train))
    return pairs.features_34(asked, train, nodes, features.STREAM_FEATURES)


def pair_features_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, train = _asked(spark, sf_dir)
    nodes = stored(features.node_features(train))
    full = pairs.features_joint(asked, nodes, features.STREAM_FEATURES, True)
    return full.select("a", "b", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in full.columns[2:]])  # no negative zeros


def recent_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(selection.chronological(stored(payment_stream(spark, sf_dir))))
    queries = edges.where("split = 'test'").select(F.col("edge_seq").alias("query_id"), F.col("src_idx").alias("node"), F.col("timestamp").alias("ts"))
    return temporal.neighbor_rows(temporal.recent_neighbors(queries, temporal.events_of(edges), NEIGHBOURS))


def neighbor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(payment_stream(spark, sf_dir))
    queries = edges.select(F.col("edge_seq").alias("query_id"), F.col("src_idx").alias("node"), F.col("timestamp").alias("ts"))
    rows = temporal.neighbor_rows(temporal.recent_neighbors(queries, temporal.events_of(edges), 3))
    names = features.STREAM_FEATURES
    return temporal.with_features(rows, features.node_features(edges), edges, names, ["sat"]).select("query_id", "pos", "nbr", "age", *names, "sat")


def recent_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.recent_partners(stored(payment_stream(spark, sf_dir)), PARTNERS)
    return p.select("edge_seq", F.array_join("src_past", ",").alias("src_past"), F.array_join("dst_past", ",").alias("dst_past"))


def neighbor_cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = temporal.recent_partners(stored(payment_stream(spark, sf_dir)), PARTNERS)
    co = temporal.cooccurrence(F.col("src_past"), F.col("dst_past"))
    return p.select("edge_seq", temporal.shared(F.col("src_past"), F.col("dst_past")).cast("long").alias("shared"), F.array_join(F.transform(co, lambda x: F.concat_ws("/", x["own"].cast("string"), x["other"].cast("string"))), ",").alias("counts"))


def relational_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.relational_vectors(stored(payment_stream(spark, sf_dir)), PARTNERS)


def eval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cands = ranking.heuristic_candidates(payment_stream(spark, sf_dir), NEGATIVES)
    return cands


def train_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stored(selection.chronological(stored(payment_stream(spark, sf_dir))))
    train = split.where("split = 'train'")
    asked = stored(train.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")).distinct())
    return candidates.negatives(asked, asked, asked, selection.nodes_of(train), 5, "t", exclude="true_only")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, cands = ranking.heuristic_candidates(payment_stream(spark, sf_dir), NEGATIVES)
    return stored(pairs.scores(cands.withColumnsRenamed({"src": "a", "cand": "b"}), train).withColumnsRenamed({"a": "src", "b": "cand"}))


def rank_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranks(_scored(spark, sf_dir), "jaccard")


def rank_mean_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranks(_scored(spark, sf_dir), "jaccard", "mean")


def heuristic_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.heuristic_ranking(payment_stream(spark, sf_dir), NEGATIVES)


def tppr_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tppr(stored(payment_stream(spark, sf_dir))).select("node", F.round("norm", 6).alias("norm"), F.size("weights").cast("long").alias("n"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(forecast.series(stored(report.daily_stats(payments(spark, sf_dir)))))


def tppr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stored(selection.chronological(stored(payment_stream(spark, sf_dir))))
    asked = stored(split.where("split = 'test'").select(F.col("src_idx").alias("a"), F.col("dst_idx").alias("b")).distinct())
    state = stored(graph.tppr(split.where("split <> 'test'")))  # all edges before those that are asked about
    found = graph.tppr_similarity(state, asked.withColumnsRenamed({"a": "src", "b": "dst"}))
    return found.withColumn("similarity", F.round("similarity", 6))


def naive_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecast.naive(_series(spark, sf_dir))
    return f.select("target", "t", "y", "model", F.round("forecast", 6).alias("forecast"))


def ts_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = forecast.metrics(forecast.naive(_series(spark, sf_dir)))
    return m.select("target", "model", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "smape")])


def fitted_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.metrics(forecast.fitted(_series(spark, sf_dir)))


def logreg_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.learned_ranking(payment_stream(spark, sf_dir), "logreg", NEGATIVES)


def forest_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.learned_ranking(payment_stream(spark, sf_dir), "forest", NEGATIVES)


def boosting_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.learned_ranking(payment_stream(spark, sf_dir), "boosting", NEGATIVES)


def pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.pairwise_ranking(payment_stream(spark, sf_dir), NEGATIVES)


def daily_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_table(streams.daily_windows(streams.read_events(spark, f"{sf_dir}/events.parquet")), "daily-windows", "complete")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_table(streams.daily_windows(streams.read_events(spark, f"{sf_dir}/events.parquet"), width="7 days", slide="1 day"), "sliding-windows", "complete")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_table(streams.sessions(streams.read_events(spark, f"{sf_dir}/events.parquet")), "sessions", "complete")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


def partner_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_to_table(streams.partners(streams.read_events(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "partner")), "partners")


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    stream_report, raw_profile, entity_mapping, mapped_edges, clean_edges, edge_positions, bipartite_edges, dense_remap, dense_bundle, date_range_slice, prefix_slice,
    chrono_split, day_windows, known_edges, undirected_stream, daily_stats, pair_rollup, neighbor_sets, active_nodes, degree_histogram, hourly_activity, tumbling_30m,
    value_histogram, entity_overlap, topk_subgraph, hub_projection, value_transforms, time_encodings, node_features_15, feature_corr, daily_node_features,
    daily_graph_features, window_mean, window_decay, triangles, pagerank, pagerank_converged, weak_components, core_numbers, strong_components, pair_scores, pair_features_7,
    pair_features_34, pair_features_extended, recent_neighbors, neighbor_features, recent_partners, neighbor_cooc, relational_vectors, eval_candidates, train_negatives,
    rank_conservative, rank_mean_tie, heuristic_ranking, tppr_state, naive_forecasts, ts_metrics, fitted_forecasts,
    logreg_ranking, forest_ranking, boosting_ranking, pairwise_ranking, daily_window_stream, sliding_window_stream, session_stream, partner_state_stream,
    daily_topology, daily_structure, daily_pagerank, daily_pagerank_gini, daily_pagerank_converged, daily_heuristics, heuristics_over_days, snapshot_events, mean_daily_features, tppr_scores,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
