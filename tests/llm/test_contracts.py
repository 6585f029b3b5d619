"""The queries' operators against plain versions, on mixed small inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidegraph.llm import exact_dedup, licenses, packing, pii, simhash, suffix_dedup

WORDS = "the of and over lazy river stone quick brown fox Jumps AGAIN é ß naïve under mit License apache version 2 cc by nc gnu".split()


def texts(n=120, seed=5):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 120))) for _ in range(25)]
    out = []
    for _ in range(n):
        t = r.choice(base)
        kind = r.random()
        if kind < 0.2:
            t = t.upper() if r.random() < 0.5 else t
        elif kind < 0.6:
            w = t.split()
            w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
        elif kind < 0.7:
            t += " mail me: a.b@c.example.com, +1 (269) 555-3296 or 10.0.255.1; 4111 1111 1111 1111 999.1.1.1 x@y@z.co.uk_q@r.s 1.2.3.4.5.6.7.8"
        elif kind < 0.75:
            t = None if r.random() < 0.5 else ""
        out.append(t)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(texts(), "doc_id long, text string").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_exact(docs):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in exact_dedup.exact_groups(docs).collect())
    assert got == sorted(brute.exact(texts()))


def test_exact_compares_bytes_when_digests_collide(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda norm: F.substring(F.sha2(norm, 256), 1, 1))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect()) == sorted(x[:4] for x in brute.exact(texts()))


def test_exact_state_goes_on(spark, tmp_path):
    arrivals, state = str(tmp_path / "a"), str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, locator long, digest string")
    frame([(1, 0, "x"), (2, 0, "y")]).write.parquet(arrivals)
    schema = spark.read.parquet(arrivals).schema
    exact_dedup.keyed_state(spark, arrivals, state, schema)
    frame([(5, 0, "x"), (3, 0, "z")]).write.mode("append").parquet(arrivals)
    exact_dedup.keyed_state(spark, arrivals, state, schema)
    groups = frame([]).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("copies")).schema
    got = {r.digest: (r.keeper.doc_id, r.copies) for r in exact_dedup.read_state(spark, state, groups).collect()}
    assert got == {"x": (5, 2), "y": (2, 1), "z": (3, 1)}


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_simhash(docs, cell_rows):
    got = sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs, cell_rows=cell_rows).collect())
    assert got == sorted(brute.components(texts()))


def test_simhash_covers_all_small_distances():
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << k
        fps = np.array([a, b], np.uint64).view(np.int64)
        anchor, index, home = simhash.anchors(fps)
        assert set(anchor[(index == 0) & home]) & set(anchor[index == 1])


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    up = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in up.items() if k in got} and len(got) == len({x for a, b in links if a != b for x in (a, b)})


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts()}
    rows = packing.pack(docs, path, capacity=64, fan_in=2, window=20).collect()
    places = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len(places) <= 1.15 * sum(map(len, ids.values())) / 64


def test_memo_equals_tokenizer():
    import public_tokenizers

    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), memo=50)
    r = random.Random(3)
    letters = "abcZ éß'’ \n\t.,!12²½ \xa0\x85\x1c<|>Σİß—日本 sStTlLdDrReEvVmM'"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert w(text) == w.whole(text), text


def test_best_fit_by_hand():
    bins, offsets, used = packing.best_fit(np.array([5, 7, 3, 5]), 10)
    assert used.tolist() == [10, 10] and bins.tolist() == [1, 0, 0, 1] and offsets.tolist() == [0, 0, 7, 5]


def test_pii(docs):
    plain = dict(texts())
    for r in pii.digest(pii.scan(docs)).collect():
        spans = brute.personal(plain[r.doc_id])
        assert r.base_sha256 == brute.base_digest(plain[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in brute.KINDS]


def test_pii_base_patterns(spark):
    r = random.Random(8)
    rows = [(k, "".join(r.choice(["a@b.co", "1.2.3.4", "+1 23 456 78901", "@", ".", "-", " ", "_", "%", "4111 1111 1111 1111", "9", "x", "é", "", "", "", "256.1.1.1"]) for _ in range(r.randint(0, 12)))) for k in range(800)]
    rows.append((9000, "1 2 " * 60_000))
    rows.append((9001, "a." * 60_000 + "@" + "b." * 60_000 + "c"))
    got = {x.doc_id: x.base_sha256 for x in pii.digest(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {k: brute.base_digest(t) for k, t in rows}


def test_pii_recall_of_the_method(spark):
    """Identifiers that no base pattern takes, in front of which, or in whose shape, others stand that one does."""
    r = random.Random(21)
    number = lambda: f"{r.randint(200, 999)} 555 {r.randint(1000, 9999)}"
    rows = [(k, f"{r.choice(['please call', 'our phone', 'ring us on', 'mobile:'])} +1 {number()} {r.choice(['now', 'soon', 'today'])}") for k in range(60)]
    planted = [(100 + k, f"filler {k} {r.choice(['please call', 'our phone', 'ring us on', 'mobile:'])} ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}, thanks") for k in range(60)]
    clean = [(200 + k, f"in section {r.randint(1000000, 9999999)} of volume {k}") for k in range(60)]
    got = {x.doc_id: x.spans for x in pii.digest(pii.scan(spark.createDataFrame(rows + planted + clean, "doc_id long, text string"))).collect()}
    assert sum(got[k].startswith("phone:") for k, _ in planted) >= 54 and not any(got[k] for k, _ in clean)


def test_pii_discovers_by_context(spark):
    rows = [(k, f"please call +1 269 555 {1000 + k} now") for k in range(8)] + [(50, "please call (269) 555-7777 now"), (51, "we counted (269) 555-7777 now")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50] == "phone:12:26" and got[51] == ""


def test_licenses(docs):
    plain = dict(texts())
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licence(plain[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licenses_by_template(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "general version public gnu license 3"), (3, "Released under the MIT License."), (4, "plain text")]
    rows += [(k, "words of no meaning") for k in range(10, 60)]
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("gpl-3", "") and got[2] == ("", "") and got[3] == ("mit", "mit") and got[4] == ("", "")


def random_repeats():
    r = random.Random(4)
    parts = ["".join(r.choice("ab é") for _ in range(r.randint(90, 260))) for _ in range(12)]
    one = lambda: r.choice(parts)[r.randint(0, 40) :] if r.random() < 0.7 else r.choice(["a" * 150, "ab" * 90, "xyz"])
    return [(k, None if k == 7 else "".join(one() for _ in range(r.randint(0, 6)))) for k in range(150)]


@pytest.mark.parametrize("cell", [4096, 2])
def test_suffix_dedup(spark, cell):
    rows = random_repeats()
    got = suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cell=cell).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))


def test_suffix_array():
    r = random.Random(6)
    for _ in range(500):
        s = [r.randint(1, r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 50))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
