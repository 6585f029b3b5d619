import itertools

import numpy as np
import pytest

from tidegraph.operators import graph
from tidegraph.plans import queries


@pytest.mark.parametrize("n, nodes, k", [(300, 12, 4), (1500, 40, 5), (2000, 200, 100), (400, 3, 2)])
@pytest.mark.parametrize("alpha, beta", [(0.9, 0.8), (0.0, 0.5), (0.5, 0.5)])
def test_levels_give_the_fold(n, nodes, k, alpha, beta):
    r = np.random.default_rng(n)
    a, b = r.integers(0, nodes, n), r.integers(0, nodes, n)  # self loops too
    top, norm = graph.tppr_fold(zip(a.tolist(), b.tolist(), strict=True), alpha, beta, k)
    found, weights, norms = graph.tppr_by_level(a, b, alpha, beta, k)
    assert {x: list(w.items()) for x, w in top.items()} == dict(zip(found.tolist(), weights, strict=True))
    assert norm == dict(zip(found.tolist(), norms.tolist(), strict=True))


def test_edges_of_a_level_share_no_end():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 50, 1000), r.integers(0, 50, 1000)
    level = graph.tppr_levels(a, b)
    assert level.max() < 300  # far fewer steps than edges
    for k in range(level.max() + 1):
        ends = list(itertools.chain.from_iterable({x, y} for x, y in zip(a[level == k].tolist(), b[level == k].tolist(), strict=True)))
        assert len(ends) == len(set(ends))


@pytest.mark.parametrize("held, chunk", [(10, 64), (0, 7), (1000, 10**6)])
def test_state_in_a_file_and_in_chunks_gives_the_fold(held, chunk):
    r = np.random.default_rng(8)
    a, b = r.integers(0, 60, 900) * 10**12, r.integers(0, 60, 900) * 10**12  # self loops too
    top, norm = graph.tppr_fold(zip(a.tolist(), b.tolist(), strict=True), 0.9, 0.8, 6)
    store = graph.TpprStore(6, held)
    for lo in range(0, len(a), chunk):
        store.fold(a[lo : lo + chunk], b[lo : lo + chunk], 0.9, 0.8)
    rows = [x for batch in store.batches(16) for x in batch.to_pylist()]
    assert {x["node"]: [(e["node"], e["weight"]) for e in x["weights"]] for x in rows} == {x: list(w.items()) for x, w in top.items()}
    assert {x["node"]: x["norm"] for x in rows} == norm


def test_similarity_in_blocks_is_the_same(spark):
    edges = spark.createDataFrame([(k % 7, 7 + k % 5, k) for k in range(60)], "src_idx long, dst_idx long, edge_seq long")
    state = graph.tppr(edges, k=5, held=2, chunk=9)
    asked = spark.createDataFrame([(a, b) for a in range(8) for b in range(6, 14)], "src long, dst long")
    one, many = (sorted(tuple(x) for x in graph.tppr_similarity(state, asked, most).collect()) for most in (1000, 10))
    assert one == many and len(one) == 64 and any(x[2] > 0 for x in one)


def test_scores_know_all_edges_before_those_asked_about(spark, monkeypatch):
    """The pair's only past edges are in the validation part."""
    rows = [(1, 2, k) for k in range(70)] + [(5, 6, k) for k in range(70, 85)] + [(5, 6, k) for k in range(85, 100)]
    monkeypatch.setattr(queries, "payment_stream", lambda *_: spark.createDataFrame(rows, "src_idx long, dst_idx long, edge_seq long"))
    assert queries.tppr_scores(spark, "").first().similarity > 0
