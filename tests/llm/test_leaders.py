"""Leaders of hot cells against a plain version, and the rows that are made to find them."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import near_copies


def test_most_frequent():
    assert near_copies.most_frequent(np.array([5, 3, 5, 9, 3, 7]), 3).tolist() == [3, 5, 7]
    assert near_copies.most_frequent(np.zeros(0, np.int64), 3).tolist() == []


def test_a_row_meets_the_leaders_of_its_cell_at_once(spark, monkeypatch):
    r = random.Random(16)
    given = sorted({(r.randint(0, 8), r.randint(0, 60)) for _ in range(400)})
    root = {k: k - k % 3 for _, k in given}
    order = {x.id: x.h for x in spark.createDataFrame([(k,) for k in root], "id long").select("id", F.xxhash64("id", F.lit(2)).alias("h")).collect()}
    cells, shared = defaultdict(list), defaultdict(Counter)
    for gram, k in given:
        cells[gram].append(k)
    for ids in cells.values():
        leads = sorted(ids, key=lambda k: (order[k], k))[:4]
        for k in ids:
            shared[k].update(v for v in leads if root[v] != root[k])
    want = {(k, max(k, v), min(k, v)) for k, c in shared.items() for v in sorted(c, key=lambda v: (-c[v], v))[:4]}
    counted = []

    def watched(df, work, schema, plain=near_copies.in_workers):
        counted.append((df.count(), len(df.columns)))
        return plain(df, work, schema)

    monkeypatch.setattr(near_copies, "in_workers", watched)
    rows = spark.createDataFrame([(g, k, root[k]) for g, k in given], "gram long, id long, root long").repartition(3)
    got = [tuple(x) for x in near_copies.led(rows, 2).select("own", "u", "v").collect()]
    assert set(got) == want and len(got) == len(want)
    assert counted == [(sum(1 for c in shared.values() if c), 2)]  # not a row for each leader of each cell
