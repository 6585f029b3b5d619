"""The graph operators on small graphs with known answers."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions.columns import file_date, finite
from tidegraph.functions.ordering import numbered
from tidegraph.operators import candidates, features, forecast, graph, pairs, ranking, report, selection, temporal
from tidegraph.plans import experiments
from tidegraph.sources import tables
from tidegraph.streaming import streams


def stream(spark, rows):
    """rows: src, dst, ts, btc."""
    data = [(k, a, b, t, float(v), float(v) * 10, round(v * 1e8)) for k, (a, b, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "edge_seq long, src_idx long, dst_idx long, timestamp long, btc double, usd double, sat long")


def test_cleaning_and_mapping(spark):
    raw = spark.createDataFrame([(1, 2, 1000, 100000000, 1000.0), (2, 3, 1001, 200000000, 2000.0), (3, 1, 1002, 50000000, 500.0), (0, 1, 1003, 10000000, 100.0), (1, 1, 1004, 300000000, 3000.0), (2, 100, 1005, 150000000, 1500.0)], "SRC_ID long, DST_ID long, TIMESTAMP long, VALUE_SATOSHI long, VALUE_USD double")
    edges = tables.clean(raw)
    assert [r.btc for r in edges.orderBy("timestamp").collect()] == [1.0, 2.0, 0.5, 1.5]
    mapping = tables.entity_mapping(tables.both_ends(raw, "SRC_ID", "DST_ID", "entity_id"))
    assert {r.entity_id: r.node_index for r in mapping.collect()} == {1: 0, 2: 1, 3: 2, 100: 3}
    assert sorted((r.src_idx, r.dst_idx) for r in tables.mapped(edges, mapping.where("entity_id <> 100")).collect()) == [(0, 1), (1, 2), (2, 0)]


def test_report(spark):
    edges = stream(spark, [(0, 1, 10, 1), (0, 1, 20, 2), (1, 2, 30, 3), (2, 2, 40, 4), (2, 0, 50, 5)])
    r = report.stream_report(edges).first()
    assert (r.num_edges, r.num_nodes, r.unique_directed_edges, r.repeated_pair_events, r.self_loops) == (5, 3, 4, 1, 1)
    assert (r.total_btc, r.mean_btc, r.median_btc, r.max_btc, r.max_out_degree) == (15.0, 3.0, 3.0, 5.0, 2)
    assert r.mean_out_degree == pytest.approx(4 / 3) and r.density_directed == pytest.approx(4 / 6)
    assert [x.timestamp for x in selection.prefix(edges, 0.4).orderBy("edge_seq").collect()] == [10, 20]
    assert selection.date_range(edges, "1970-01-01", "1970-01-01").count() == 5
    none = report.stream_report(edges.where("false")).first()
    assert (none.num_edges, none.num_nodes, none.density_directed, none.timestamp_min) == (0, 0, 0.0, None)
    with pytest.raises(ValueError):
        selection.prefix(edges, 0)


def test_numbering_is_the_sorted_order(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 9), r.randint(0, 99)) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n").orderBy("n").collect()
    assert [(x.a, x.b) for x in got] == sorted(rows) and [x.n for x in got] == list(range(500))


@pytest.mark.parametrize(("rows", "node", "feature", "value"), [
    ([(0, 1, 100, 1)], 1, "log_in_degree", math.log(2)),
    ([(0, 1, 100, 1)], 0, "burstiness", 0.0),
    ([(0, 1, 1, 1), (0, 2, 2, 1), (0, 3, 3, 1)], 0, "in_out_ratio", 1.0),
    ([(0, 2, 1, 3), (1, 2, 2, 5)], 2, "log_total_btc_in", math.log(9)),
    ([(0, 1, 1, 4), (0, 2, 2, 6)], 0, "log_avg_btc_out", math.log(6)),
    ([(0, 1, t, 1) for t in (100, 200, 300, 400, 500)], 0, "burstiness", -1.0),
    ([(0, 1, 1, 1), (0, 2, 2, 1), (0, 1, 3, 1), (0, 2, 4, 1)], 0, "out_entropy", 1.0),
    ([(0, 2, 100, 1), (1, 2, 500, 1)], 0, "activity_span", 0.0),
    ([(5, 5, 7, 0)], 5, "log_event_rate", 0.0),
])
def test_node_features(spark, rows, node, feature, value):
    got = {r.node_idx: r for r in features.node_features(stream(spark, rows)).collect()}
    assert got[node][feature] == pytest.approx(value, abs=1e-5)
    assert all(math.isfinite(x) for r in got.values() for x in r)


def test_daily_graph_features(spark):
    day = report.daily(stream(spark, [(0, 1, 5, 1), (1, 2, 6, 1), (2, 0, 7, 1), (0, 1, 90000, 1), (0, 2, 90001, 2), (0, 3, 90002, 3), (0, 4, 90003, 4)]))
    got = {str(r.date): r for r in features.daily_graph_features(day).collect()}
    tri, star = got["1970-01-01"], got["1970-01-02"]
    assert (tri.num_nodes, tri.num_edges, tri.reciprocity, tri.total_btc, tri.gini_degree) == (3, 3, 0.0, 3.0, 0.0)
    assert (star.num_nodes, star.max_degree, star.assortativity) == (5, 4, 0.0)
    nodes = {r.node_idx: r for r in features.daily_node_features(day).where("date = '1970-01-02'").collect()}
    assert (nodes[0].out_degree, nodes[0].in_degree, nodes[0].total_btc_out) == (4, 0, 10.0)
    values = spark.createDataFrame([("a", 0), ("a", 0), ("a", 0), ("a", 100), ("b", 1), ("b", 1), ("c", 0)], "g string, v long")
    gini = {r.g: r.gini for r in features.gini(values, "v", ["g"]).collect()}
    assert gini["a"] > 0.7 and gini["b"] == 0 and gini["c"] == 0


def test_triangles_and_cores(spark):
    got = {r.node: r for r in graph.triangles(stream(spark, [(0, 1, 1, 1), (1, 2, 2, 1), (2, 0, 3, 1), (3, 4, 4, 1), (4, 5, 5, 1)])).collect()}
    assert [got[k].triangles for k in range(6)] == [1, 1, 1, 0, 0, 0] and got[0].clustering == 1.0 and got[4].clustering == 0.0
    r = random.Random(2)
    links = {(a, b) for a, b in ((r.randint(0, 25), r.randint(0, 25)) for _ in range(90)) if a != b}
    near = {x: {b for a, b in links if a == x} | {a for a, b in links if b == x} for x in {y for e in links for y in e}}
    core, left = {}, {x: set(n) for x, n in near.items()}
    for k in itertools.count():
        if not left:
            break
        while low := [x for x, n in left.items() if len(n) <= k]:
            for x in low:
                core[x] = k
                for y in left.pop(x):
                    if y in left:
                        left[y].discard(x)
    assert {x.node: x.core for x in graph.core_numbers(stream(spark, [(a, b, 1, 1) for a, b in links])).collect()} == core


def test_wedges_are_met_once(spark):
    edges = stream(spark, [(0, k, 1, 1.0) for k in range(1, 6)] + [(a, b, 1, 1.0) for a, b in itertools.combinations(range(10, 15), 2)])
    up = graph.oriented(graph.undirected(edges))
    ahead = [x["count"] for x in up.groupBy("u").count().collect()]
    assert graph.wedges(up).count() == sum(math.comb(n, 2) for n in ahead) == 10
    assert {x.node: x.triangles for x in graph.triangles(edges).collect()} == dict.fromkeys(range(6), 0) | dict.fromkeys(range(10, 15), 6)


def test_pagerank(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 12), r.randint(0, 14)) for _ in range(40)] + [(0, 1), (0, 1)]
    nodes = sorted({x for e in rows for x in e})
    n, at = len(nodes), {x: k for k, x in enumerate(nodes)}
    m = np.zeros((n, n))
    for a, b in rows:
        m[at[b], at[a]] += 1
    out = m.sum(axis=0)
    p = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.15 / n + 0.85 * (m @ np.divide(p, out, out=np.zeros(n), where=out > 0) + p[out == 0].sum() / n)
        if np.abs(new - p).sum() < 1e-6:
            break
        p = new
    got = {x.node: x.rank for x in graph.pagerank(stream(spark, [(a, b, 1, 1) for a, b in rows])).collect()}
    assert [got[x] for x in nodes] == pytest.approx((p / p.sum()).tolist(), abs=1e-9)


def test_components(spark):
    edges = stream(spark, [(5, 3, 1, 1), (3, 9, 2, 1), (20, 21, 3, 1)] + [(k, k + 1, 4, 1) for k in range(30, 60)])
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got[9] == 3 and got[21] == 20 and got[60] == 30
    assert graph.strong_components_of([0, 1, 2, 2, 7], [1, 2, 0, 3, 7]) == {0: 0, 1: 0, 2: 0, 3: 3, 7: 7}


def test_tppr(spark):
    top, norm = graph.tppr_fold([(0, 1)], 0.9, 0.8, 5)
    assert top[0][1] > 0 and top[1][0] > 0 and norm[0] == norm[1]
    state = graph.tppr(stream(spark, [(0, 1, 1, 1), (0, 1, 2, 1), (2, 3, 3, 1)] + [(0, k, 4 + k, 1) for k in range(4, 14)]), k=5)
    held = {r.node: r.weights for r in state.collect()}
    assert max(map(len, held.values())) <= 5
    sim = {(r.src, r.dst): r.similarity for r in graph.tppr_similarity(state, spark.createDataFrame([(0, 1), (1, 0), (0, 99)], "src long, dst long")).collect()}
    assert sim[0, 1] > 0 and sim[0, 1] == pytest.approx(sim[1, 0]) and sim[0, 99] == 0


def test_pair_scores(spark):
    edges = stream(spark, [(a, b, 1, 1) for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (3, 5), (3, 6)]])
    asked = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3), (4, 5), (4, 6), (0, 0), (3, 3), (7, 0)], "a long, b long")
    got = {(r.a, r.b): r for r in pairs.scores(asked, edges).collect()}
    assert [got[p].cn for p in [(0, 1), (0, 2), (1, 2), (0, 3), (4, 5), (4, 6), (0, 0), (3, 3), (7, 0)]] == [1, 1, 1, 0, 1, 1, 2, 3, 0]
    assert got[0, 1].aa == pytest.approx(1 / math.log(2), abs=1e-6) and got[4, 5].aa == pytest.approx(1 / math.log(3), abs=1e-6)
    assert got[4, 5].jaccard == 1.0 and got[0, 3].pa == 6
    nodes = spark.createDataFrame([(0, 2.0), (1, 3.0)], "node_idx long, f double")
    joint = {(r.a, r.b): r for r in pairs.features_joint(asked, nodes, ["f"], True).collect()}
    assert (joint[0, 1].diff_f, joint[0, 1].prod_f, joint[0, 3].src_f) == (-1.0, 6.0, 0.0)


def test_recent_neighbors_never_look_ahead(spark):
    r = random.Random(5)
    rows = sorted((r.randint(0, 20), r.randint(0, 5), r.randint(0, 9)) for _ in range(200))
    edges = stream(spark, [(a, b, t, 1) for t, a, b in rows])
    asked = [(k, r.randint(0, 7), r.randint(0, 22)) for k in range(60)]
    got = temporal.recent_neighbors(spark.createDataFrame(asked, "query_id long, node long, ts long"), temporal.events_of(edges), 4).collect()
    assert len(got) == 60
    for x in got:
        want = [(t, k, b) for k, (t, a, b) in enumerate(rows) if a == x.node and t < x.ts][-4:]
        assert [tuple(e) for e in x.nbrs] == want


def test_carried_neighbours_are_those_joined_by_rank(spark, monkeypatch):
    r = random.Random(3)
    events = spark.createDataFrame([(r.randint(0, 4), r.randint(0, 9), r.randint(0, 30), k) for k in range(120)], "node long, nbr long, ts long, seq long")
    asked = spark.createDataFrame([(k, r.randint(0, 6), r.randint(0, 32)) for k in range(90)], "query_id long, node long, ts long")
    found = []
    for most in (0, 8):
        monkeypatch.setattr(temporal, "CARRIED", most)
        got = temporal.recent_neighbors(asked, events, 3)
        assert got.columns == ["query_id", "node", "ts", "nbrs"]
        found.append({x.query_id: (x.node, x.ts, [tuple(y) for y in x.nbrs]) for x in got.collect()})
    assert found[0] == found[1] and len(found[0]) == 90


def test_relational_vectors(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 5), r.randint(6, 11)) for _ in range(40)]
    n, k2 = 4, 2
    past = {x: [] for x in range(12)}
    want = {}
    for seq, (u, v) in enumerate(rows):
        last = {x: p[-n:] for x, p in past.items()}
        hop2 = {x: {z for y in last[x] for z in past[y][-k2:]} for x in last}
        share = lambda a, b: len(set(a) & set(b)) / (len(a) * len(b)) if a and b else 0.0
        for base, a in ((0, u), (n, v)):
            for k, b in enumerate(last[a]):
                value = []
                for q in (u, v):
                    for c in (a, b):
                        value += [last[c].count(q) / len(last[c]) if last[c] else 0.0, share(last[q], last[c]), share(hop2[q], hop2[c])]
                want[seq, base + k] = [round(x, 6) for x in value]
        past[u].append(v)
        past[v].append(u)
    got = {(x.edge_seq, x.place): [x[f"r{k}"] for k in range(12)] for x in temporal.relational_vectors(stream(spark, [(u, v, s, 1) for s, (u, v) in enumerate(rows)]), n).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_negatives(spark):
    r = random.Random(7)
    pairs_ = sorted({(r.randint(0, 9), r.randint(10, 29)) for _ in range(80)})
    frame = spark.createDataFrame(pairs_, "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(30)], "node long")
    queries = spark.createDataFrame(pairs_[::4], "src long, dst long")
    positives = spark.createDataFrame(pairs_[::4], "src long, dst long")
    got = [tuple(x) for x in candidates.negatives(queries, frame, positives, nodes, 8).collect()]
    again = [tuple(x) for x in candidates.negatives(queries.repartition(5), frame.repartition(3), positives, nodes, 8).collect()]
    assert sorted(got) == sorted(again)
    good = set(pairs_[::4])
    for q in pairs_[::4]:
        own = [c for s, d, c, _ in got if (s, d) == q]
        assert len(own) == len(set(own)) == 8 and q[0] not in own and all((q[0], c) not in good for c in own)
    few = candidates.negatives(queries, frame, positives, nodes.where("node < 12"), 40).collect()
    assert max(sum((x.src, x.dst) == q for x in few) for q in pairs_[::4]) < 40


def test_negatives_are_filled_where_nodes_are_left(spark):
    """Nearly all nodes are positives of the only source: random draws miss the few that are allowed, the walk does not."""
    allowed = {17, 905, 1999, 4000, 4500, 4999}
    known = spark.createDataFrame([(0, k) for k in range(1, 5000) if k not in allowed], "src long, dst long")
    nodes = spark.range(5000).withColumnRenamed("id", "node")
    for n, want in ((4, 4), (6, 6), (20, 6)):
        got = candidates.negatives(known.where("dst = 3"), known, known, nodes, n).collect()
        assert len(got) == want and {x.cand for x in got} <= allowed and len({x.cand for x in got}) == want


def test_past_partners_come_in_hash_order_from_blocks(spark):
    """A source with many partners: the first of each query in md5 order, whatever blocks they are met in; none that are barred."""
    known = [(1, k) for k in range(2, 60)] + [(2, 5), (2, 6)]
    frame = spark.createDataFrame(known, "src long, cand long")
    asked = spark.createDataFrame([(1, 7), (1, 9), (2, 5), (3, 4)], "src long, dst long")
    order = lambda s, d, c: hashlib.md5(f"x|{s}|{d}|{c}".encode()).hexdigest()
    for block in (1, 7, 1024):
        got = {(x.src, x.dst): x.had for x in candidates._past(asked, frame, 3, "x", block).collect()}
        assert got == {(s, d): sorted((c for a, c in known if a == s and c != d), key=lambda c: order(s, d, c))[:3] for s, d in ((1, 7), (1, 9), (2, 5), (3, 4))}


def test_draws_looked_up_at_first_change_nothing(spark, monkeypatch):
    pairs_ = [(k, 30 + j) for k in range(8) for j in range(12)]
    frame = spark.createDataFrame(pairs_, "src long, dst long")
    nodes = spark.range(42).withColumnRenamed("id", "node")
    found = []
    for ahead in (0, 100):
        monkeypatch.setattr(candidates, "AHEAD", ahead)
        found.append(sorted(tuple(x) for x in candidates.negatives(frame, frame, frame, nodes, 10).collect()))
    assert found[0] == found[1] and len(found[0]) == 10 * len(pairs_)


def test_common_neighbours_in_parts(spark):
    r = random.Random(9)
    adjacency = {(a, b) for a, b in ((r.randint(0, 25), r.randint(0, 25)) for _ in range(150)) if a != b}
    asked = [(a, b) for a in range(0, 28) for b in range(0, 28, 3)]
    near = {k: {b for a, b in adjacency if a == k} for k in range(28)}
    frame, pair = spark.createDataFrame(sorted(adjacency), "u long, v long"), spark.createDataFrame(asked, "a long, b long")
    for most in (400, 10**6):
        got = {(x.a, x.b): (x.cn_x, x.aa_x) for x in pairs.common(pair, frame, "_x", most).collect()}
        for a, b in asked:
            assert got[a, b] == (len(near[a] & near[b]), pytest.approx(sum(1 / math.log(len(near[v])) for v in near[a] & near[b] if len(near[v]) > 1)))


def test_ranks(spark):
    rows = [(1, 1, 10.0, 1), (1, 1, 5.0, 0), (1, 1, 3.0, 0), (2, 2, 1.0, 1), (2, 2, 5.0, 0), (2, 2, 3.0, 0), (2, 2, 10.0, 0), (3, 3, 5.0, 1), (3, 3, 5.0, 0), (3, 3, 5.0, 0)]
    frame = spark.createDataFrame(rows, "src long, dst long, s double, is_true int")
    assert {r.src: r["rank"] for r in ranking.ranks(frame, "s").collect()} == {1: 1.0, 2: 4.0, 3: 1.0}
    assert {r.src: r["rank"] for r in ranking.ranks(frame, "s", "mean").collect()} == {1: 1.0, 2: 4.0, 3: 2.0}
    m = ranking.summary(spark.createDataFrame([(float(x),) for x in (1, 3, 2, 5, 1)], "rank double")).first()
    assert (m.n_queries, m.hits_1, m.hits_3, m.hits_10) == (5, 0.4, 0.8, 1.0)


def test_forecasts(spark):
    y = np.array([10 + k % 7 for k in range(70)], float)
    assert forecast.holt_winters(y, 7, 0.2, 0.0, 0.1) == pytest.approx(y[:7], abs=0.5)
    assert forecast.autoregression(np.arange(50.0), 3, 1, 1) == pytest.approx([50, 51, 52], abs=1e-6)
    m = forecast.metrics(spark.createDataFrame([("t", "m", a, b) for a, b in zip((100.0, 200.0, 300.0, 400.0), (110.0, 190.0, 310.0, 380.0), strict=True)], "target string, model string, y double, forecast double")).first()
    assert m.mae == 12.5


def test_sources(spark, tmp_path):
    (tmp_path / "j.csv").write_text("user,item,t,y,f\n1,2,30,1,.5,1.5\n0,1,10,0,2,3\n")
    got = tables.jodie(spark, str(tmp_path / "j.csv")).orderBy("edge_seq").collect()
    assert [(r.timestamp, r.src_idx, r.dst_idx, r.btc, r.usd) for r in got] == [(10, 0, 3, 2.0, 3.0), (30, 1, 4, 0.5, 1.5)]
    flat = spark.createDataFrame([(10, 20, 30, 1.5), (11, 21, 10, 2.5)], "source long, target long, ts long, amount double")
    got = tables.edge_table(flat, "source", "target", "ts", "amount", default_usd=7.0, remap=True).orderBy("edge_seq").collect()
    assert [(r.timestamp, r.src_idx, r.usd) for r in got] == [(10, 1, 7.0), (30, 0, 7.0)]
    edges = stream(spark, [(100, 200, 10, 1), (300, 100, 20, 2), (200, 300, 30, 3)])
    few, nodes = tables.dense_bundle(edges, spark.createDataFrame([(100, 1.0), (200, 2.0), (300, 3.0), (999, 9.0)], "node_idx long, f double"), 2)
    assert [(r.src_idx, r.dst_idx) for r in few.orderBy("edge_seq").collect()] == [(0, 1), (2, 0)] and nodes.count() == 3
    tables.write_stream(edges, str(tmp_path / "s"))
    assert tables.open_stream(spark, str(tmp_path / "s")).count() == 3
    with pytest.raises(ValueError):
        flat.write.parquet(str(tmp_path / "bad"))
        tables.open_stream(spark, str(tmp_path / "bad"))
    flat.coalesce(1).write.parquet(str(tmp_path / "raw" / "x"))
    part = next((tmp_path / "raw" / "x").glob("*.parquet"))
    part.rename(tmp_path / "raw" / "orbit-snapshot-date-2020-06-01.parquet")
    assert str(tables.snapshots(spark, str(tmp_path / "raw")).first().date) == "2020-06-01"


def test_columns(spark):
    r = spark.range(1).select(file_date(F.lit("snap_2020_01_31.csv")).cast("string").alias("a"), file_date(F.lit("none")).alias("b"), finite(F.lit(float("nan"))).alias("c"), finite(F.lit(float("inf"))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("2020-01-31", None, 0.0, 0.0)


def test_experiments(spark, tmp_path):
    spec = experiments.Spec.from_dict({"name": "h", "negatives": 3, "unknown": 1})
    assert spec.extra == {"unknown": 1}
    spec.dump(str(tmp_path / "s.json"))
    assert experiments.Spec.load(str(tmp_path / "s.json")) == spec
    r = random.Random(9)
    edges = stream(spark, [(r.randint(0, 9), r.randint(10, 19), k, 1) for k in range(200)])
    rows = experiments.launch(edges, spec, str(tmp_path / "log"))
    assert len(rows) == 4 and experiments.launch(edges, spec, str(tmp_path / "log")) == rows
    assert experiments.summary(str(tmp_path / "log")).count("\n") == 5
    with pytest.raises(ValueError):
        experiments.launch(edges, experiments.Spec(model="none"), str(tmp_path))


def test_complete_streams_do_not_double_rows(spark, tmp_path):
    import datetime

    path = f"{tmp_path}/events.parquet"
    day = lambda d, k: (k, k, datetime.datetime(2024, 1, d, k % 24), "buy", 1.0, '{"k": 1}')
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
    spark.createDataFrame([day(1, k) for k in range(5)], schema).coalesce(1).write.parquet(path)
    spark.createDataFrame([day(d, k) for d in (1, 2) for k in range(5, 8)], schema).coalesce(1).write.mode("append").parquet(path)
    found = streams.run_to_table(streams.daily_windows(streams.read_events(spark, path, 1)), "two-batches", "complete").collect()
    assert sorted((x.window_start.day, x.n) for x in found) == [(1, 8), (2, 3)]


def test_hub_links_fill_their_slots(spark):
    rows = [(0, k, 1_000_000 + k, 10, 1.0) for k in range(1, 61) for _ in range(1 + k % 3)] + [(k, 0, 2_000_000, 10, 1.0) for k in range(1, 4)]
    edges = spark.createDataFrame([(*r, r[3] / 1e8) for r in rows], "src_idx long, dst_idx long, timestamp long, sat long, usd double, btc double")
    got = report.hub_links(edges).collect()
    assert len(got) == 39 and sum(x.direction == "in" for x in got) == 3 and {x.hub for x in got} == {0}
    assert sum(x.event_count == 3 for x in got) == 20 and len(report.hub_links(edges, 40, 21).collect()) == 21
