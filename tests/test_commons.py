import math
import random

import pytest

from tidegraph.operators import graph, pairs


def test_common_neighbours_between_blocks_and_in_rounds(spark, monkeypatch):
    """Hubs over several rows, two graphs at once, tasks in rounds: cn, aa and degrees of every pair, other columns kept."""
    monkeypatch.setattr(pairs, "LISTED", 8)
    monkeypatch.setattr(pairs, "CHUNK", 16)
    r = random.Random(4)
    one = {(0, k) for k in range(1, 60)} | {(r.randint(0, 59), r.randint(0, 59)) for _ in range(400)}
    two = {(r.randint(0, 9), r.randint(10, 70)) for _ in range(150)}  # most ends have no list of their own
    asked = [(r.randint(0, 75), r.randint(0, 75), str(k)) for k in range(600)]
    frame = lambda rows: spark.createDataFrame(sorted(rows), "u long, v long")
    for most, sent in ((10**6, 10**6), (300, 3000)):
        got = {x.tag: x for x in pairs.commons(spark.createDataFrame(asked, "a long, b long, tag string"), {"": frame(one), "_x": frame(two)}, most, sent).collect()}
        assert len(got) == len(asked)
        for a, b, tag in asked:
            for name, graph in (("", one), ("_x", two)):
                near = lambda n, g=graph: {v for u, v in g if u == n}
                both = near(a) & near(b)
                aa = sum(1 / math.log(len(near(v))) for v in both if len(near(v)) > 1)
                found = got[tag]
                assert (found.a, found.b, found[f"cn{name}"], found[f"aa{name}"], found[f"da{name}"], found[f"db{name}"]) == (a, b, len(both), pytest.approx(aa), len(near(a)), len(near(b)))


def test_common_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "u long, v long")
    found = pairs.common(spark.createDataFrame([(1, 2)], "a long, b long"), none).collect()
    assert [tuple(x) for x in found] == [(1, 2, 0, 0.0)]
    assert pairs.common(spark.createDataFrame([], "a long, b long"), none).collect() == []


def test_triangles_send_no_wedges(spark, monkeypatch):
    """A graph with many wedges and few triangles: both are right, and no wedge becomes a row."""
    monkeypatch.setattr(graph, "wedges", lambda *_: 1 / 0)
    rows = [(0, k) for k in range(1, 200)] + [(1, 2), (2, 1), (2, 3), (3, 3), (300, 301)]
    got = {x.node: tuple(x)[1:] for x in graph.triangles(spark.createDataFrame(rows, "src_idx long, dst_idx long")).collect()}
    assert got[0] == (199, 2, 4 / (199 * 198)) and got[2] == (3, 2, 4 / 6) and got[1] == (2, 1, 1.0) and got[9] == got[300] == (1, 0, 0.0) and len(got) == 202
