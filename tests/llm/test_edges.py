"""Nulls, empty tables, repeated rows and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegraph.llm import decontamination, exact_dedup, html_text, licenses, packing, pii, simhash, suffix_dedup, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "norm digest locator fp key h w bin place used score row spans words found base first count label keeper".split()


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


OPERATORS = {
    "exact": lambda d, s: exact_dedup.exact_groups(d, locator=F.monotonically_increasing_id()),
    "packing": lambda d, s: packing.pack(d, vocabulary("word_bpe_49k.json")),
    "pii": lambda d, s: pii.digest(pii.scan(d)),
    "tokens": lambda d, s: token_count.token_counts(d, vocabulary("piece_bpe_32k.model")),
    "html": lambda d, s: html_text.extract(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.train(d, s.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int"))),
    "suffix": lambda d, s: suffix_dedup.cut(d),
    "licenses": lambda d, s: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    long = "under the mit license a@b.co " * 3000
    rows = [(1, None), (1, None), (2, ""), (None, "x y z"), (None, None), (3, long), (3, long), (4, long), (5, "\x00 \t\n"), (6, "words " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](docs, spark)
    n = out.where("piece = 0").count() if name == "packing" else out.count()
    assert n == len(rows)
    empty = OPERATORS[name](docs.where("false"), spark)
    assert empty.count() == 0


def test_exact_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "A"), (3, "a"), (1, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, locator=F.monotonically_increasing_id()).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got if r.doc_id) == [(1, 3, 3), (3, 3, 3), (3, 3, 3)]
    assert sum(r.kept for r in got if r.doc_id) == 1 and sum(r.kept for r in got if not r.doc_id) == 1


@pytest.mark.parametrize("clash", [False, True])
def test_exact_hot_groups(spark, clash):
    rows = [(k, "Hot" if k % 2 else "hot") for k in range(300)] + [(300 + k, f"text {k // 3}") for k in range(90)]
    digest = (lambda norm: F.substring(norm, 1, 1)) if clash else exact_dedup.sha256
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), F.monotonically_increasing_id(), digest).collect()
    want = {k: (299, 300) if k < 300 else (300 + (k - 300) // 3 * 3 + 2, 3) for k, _ in rows}
    assert len(got) == len(rows) and {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted({keep for keep, _ in want.values()})


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.contaminated(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, tmp_path, step):
    name, stage = corpus_pipeline.STAGES[step]
    text = "some river stone and a long enough sentence of words to stand alone here"
    rows = [(1, text, None, None, None), (2, text.upper(), "en", "s", 1), (3, None, None, None, 0), (4, "", "en", None, 0), (5, "other words entirely " * 500, "de", "s", 9), (5, "other words entirely " * 500, "de", "s", 9)]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("fp", F.lit(2)).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such thing anywhere in these texts at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for given in (docs, docs.where("false")):
        given.write.mode("overwrite").parquet(str(tmp_path / "in"))
        given = spark.read.parquet(str(tmp_path / "in"))
        out = stage(spark, given, str(tmp_path))
        if step < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert (out.count() == 0) == given.isEmpty()


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_every_licence_of_a_long_notices_file_is_found(spark):
    notices = "\n\n".join(text for _, text in licenses.TEMPLATES)
    rows = [(1, notices)] + [(k, "licensed under a gnu general public license") for k in range(10, 40)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].split(",") == sorted({label for label, _ in licenses.TEMPLATES}) and got[10] == ""


def test_exact_state_is_hit_over_micro_batches(spark):
    rows = [(k, f"text {k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, F.col("doc_id"), batch_bytes=1).collect()}
    most = {k % 7: k for k in range(40)}
    assert got == {k: (most[k % 7], sum(j % 7 == k % 7 for j in range(40)), most[k % 7] == k) for k in range(40)}


def test_names_and_settings_are_left_alone(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.createDataFrame([(1, "a b c", 5, 6, 7, 8), (2, "A b c", 5, 6, 7, 8)], "doc_id long, text string, text_ int, score_ int, locator_ int, gone_ int").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "not there at all")], "item_id long, text string")
    for found, n in ((toxicity.without_toxic(docs, labels), 2), (exact_dedup.drop_copies(docs), 1), (simhash.one_of_each(docs), 1), (decontamination.without_contaminated(docs, bench), 2)):
        assert found.columns == docs.columns and [tuple(x)[2:] for x in found.collect()] == [(5, 6, 7, 8)] * n
    assert spark.conf.get(key) == before
