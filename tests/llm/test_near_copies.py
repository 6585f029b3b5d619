"""Near copies of the pipeline against a plain version."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tidegraph.llm import near_copies


def shingles(text):
    words = brute.lower(text).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randint(0, 10**6)}"
    return " ".join(out)


def rows():
    r = random.Random(11)
    out = []
    for _ in range(12):
        words = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(3, 250))]
        out += [edited(r, words, r.randint(0, max(1, len(words) // 40))) for _ in range(6)]
    out += ["", None, " \t", "One two", "one  TWO"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("cell_rows, rounds", [(1024, 2), (2, 1), (2, 0)])
def test_groups(spark, cell_rows, rounds):
    given = rows()
    sets = [shingles(t) for _, t in given]
    low = list(range(len(given)))
    links = [(a, b) for a in low for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    assert len(links) > 30
    for _ in given:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    docs = spark.createDataFrame([(k, t or "") for k, t in given], "id long, text string").repartition(5)
    got = {x.node: x.root for x in near_copies.groups(docs, cell_rows, rounds).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in enumerate(low) if k != v}


def test_stage_removes_near_copies_of_distant_fingerprints(spark):
    r = random.Random(12)
    given = []
    for k in range(0, 60, 2):
        words = [f"w{r.randint(0, 3000)}" for _ in range(150)]
        given += [(k, " ".join(words)), (k + 1, edited(r, words, 2))]
    sets = {k: shingles(t) for k, t in given}
    assert all(similarity(sets[k], sets[k + 1]) >= 0.8 for k in range(0, 60, 2))
    assert sum((brute.fingerprint(a[1]) ^ brute.fingerprint(b[1])).bit_count() > 3 for a, b in zip(given[::2], given[1::2], strict=True)) > 10
    docs = spark.createDataFrame([*given, (None, given[0][1])], "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert got - {None} == set(range(0, 60, 2))


def test_sketches_never_differ_in_more_than_the_sets():
    r = random.Random(14)
    for n in (1, 5, 60, 400, 3000):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        a, b = (near_copies.grams(edited(r, words, r.randint(0, n // 8))) for _ in range(2))
        differ = sum(int(x).bit_count() for x in (near_copies.sketch(a) ^ near_copies.sketch(b)).view("uint64"))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
        if similarity(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert near_copies.may_differ(len(a), len(b), differ)


def test_large_group_is_linked_through_leaders(spark):
    """Copies of one text that are often too far from one another; chains of them count, and no pair of them is met late."""
    r = random.Random(13)
    words = [f"w{k}" for k in range(150)]
    given = [(k, edited(r, words, 2)) for k in range(150)] + [(200 + k, " ".join([*words[:40], *(f"y{r.randint(0, 10**6)}" for _ in range(110))])) for k in range(40)]
    sets = {k: shingles(t) for k, t in given}
    low = {k: k for k in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                if similarity(sets[a], sets[b]) >= 0.8:
                    low[a] = low[b] = min(low[a], low[b])
    docs = spark.createDataFrame(given, "id long, text string").repartition(5)
    for hot_roots in (1, 8, 10**6):
        got = {x.node: x.root for x in near_copies.groups(docs, 16, 1, hot_roots).collect()}
        assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in low.items() if k != v}


def test_long_sketches_rule_out_what_short_ones_leave(spark):
    """Long texts differ in more shingles than a short sketch has bits: the long one tells them, and none that are similar."""
    r = random.Random(15)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(3000)]
    given = [(k, edited(r, words, n)) for k, n in enumerate((20, 20, 20, 400, 400, 900))]
    sets = {k: near_copies.grams(t) for k, t in given}
    for own in sets.values():
        long = near_copies.long_sketch(own)
        assert len(long) * 8 >= 2 * len(own) and (near_copies.folded(long, 32).view("int64") == near_copies.sketch(own)).all()
    docs = spark.createDataFrame(given, "id long, text string")
    _, sketches = near_copies.cells(docs)
    pairs = spark.createDataFrame([(a, b) for a in sets for b in range(a)], "u long, v long")
    left = {(x.u, x.v) for x in near_copies.close(pairs, sketches).collect()}
    alike = {(a, b) for a in sets for b in range(a) if similarity(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8}
    assert alike <= left and (4, 3) not in left and (5, 0) not in left
    assert {(x.u, x.v) for x in near_copies.similar(pairs, docs).collect()} == alike


def test_a_pair_is_met_where_its_first_shared_shingle_is():
    """Not at shingles too far behind to be the first, nor at those behind one that both have."""
    size = 60

    def met(cells):
        rows = [(g, 0, 0, 2, k, 1000, place, k, before, 0, 0, 0, 0) for g, place, before in cells for k in range(size)]
        names = ["gram", "x", "y", "side", "id", "n", "place", "root", "before", *near_copies.WORDS]
        batch = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)], names=names)
        return [x for b in near_copies._met(iter([batch])) for x in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]

    every = sorted((a, b) for a in range(size) for b in range(a))
    assert sorted(met([(7, 0, 7)])) == sorted(met([(7, 111, 7)])) == every
    assert met([(7, 112, 7)]) == met([(7, 150, 7)]) == []
    assert met([(7, 3, 5)]) == [] and sorted(met([(5, 2, 5), (7, 3, 5)])) == every


def test_pairs_of_all_lengths_are_met_by_their_first_shared_shingle(spark):
    """Parts of texts, down to four fifths, and edited ones: no similar pair is lost, with cells cut into blocks or not."""
    r = random.Random(16)
    given = []
    for _ in range(30):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 120))]
        for _ in range(4):
            part = words[: max(5, len(words) - r.randint(0, len(words) // 4))]
            given.append((len(given), edited(r, part, r.randint(0, max(1, len(part) // 45)))))
    sets = {k: shingles(t) for k, t in given}
    alike = {(a, b) for a in sets for b in range(a) if similarity(sets[a], sets[b]) >= 0.8}
    assert len(alike) > 20 and any(len(sets[a]) != len(sets[b]) for a, b in alike)
    docs = spark.createDataFrame(given, "id long, text string").repartition(5)
    found, sketches = near_copies.cells(docs)
    for cell_rows in (1024, 2):
        assert alike <= {(x.u, x.v) for x in near_copies.candidates(found.withColumn("root", found["id"]), sketches, cell_rows).collect()}
