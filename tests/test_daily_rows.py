from tidegraph.operators import features


def test_daily_features_send_each_end_of_an_edge_once(spark):
    rows = [("2020-01-01", 1, 2, 1.0, 1.0, 10**8), ("2020-01-01", 1, 2, 3.0, 1.0, 3 * 10**8), ("2020-01-01", 1, 3, 2.0, 1.0, 2 * 10**8), ("2020-01-02", 2, 1, 1.0, 1.0, 10**8)]
    daily = spark.createDataFrame(rows, "date string, src_idx long, dst_idx long, btc double, usd double, sat long")
    f = features.daily_node_features(daily)
    plan = f._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan  # one row an end, not one for each distinct count
    got = {(r.date, r.node_idx): (r.unique_in, r.unique_out, r.out_degree, r.median_btc_out) for r in f.collect()}
    assert got["2020-01-01", 1] == (0, 2, 3, 2.0) and got["2020-01-01", 2] == (1, 0, 0, 0.0) and got["2020-01-02", 1] == (1, 0, 0, 0.0)
