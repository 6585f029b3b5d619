"""Core numbers against the fixpoint by its definition, with hubs whose lists are cut and without."""

import random

from tidegraph.operators import graph


def plain(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        k = max(k, min(len(x) for x in near.values()))
        node = min(near, key=lambda x: len(near[x]))
        core[node] = k
        for x in near.pop(node):
            near[x].discard(node)
    return core


def test_core_numbers_with_hubs_and_chains(spark):
    r = random.Random(17)
    pairs = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(6)]
    pairs += [(r.randint(1, 8), r.randint(1, 60)) for _ in range(150)] + [(r.randint(1, 60), r.randint(1, 60)) for _ in range(80)]
    edges = spark.createDataFrame(pairs, "src_idx long, dst_idx long")
    assert {x.node: x.core for x in graph.core_numbers(edges, listed=7).collect()} == plain(pairs)


def test_pairs_are_joined_once_not_in_each_round(spark, monkeypatch):
    written = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": written.append((name, df.inputFiles())) or keep(df, name))
    pairs = [(k, k + 1) for k in range(12)]
    assert {x.core for x in graph.core_numbers(spark.createDataFrame(pairs, "src_idx long, dst_idx long")).collect()} == {1}
    assert sum(name == "core" for name, _ in written) > 5
    assert sum(any("/both-" in f for f in files) for _, files in written) == 2
