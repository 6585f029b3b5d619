"""License scan by a positional rare-token index.

The index holds, for each telling word of the licence templates, the templates and places where it stands. Each
file's licence words are weighted by their inverse document frequency over all files, and their postings are
intersected by relative position: words that stand in the file as far apart as in a template vote for it at one
offset. Every licence word of a file votes; the index has a few dozen. A template is found where enough of its weight
votes at one offset and one of its mandatory phrases stands in the file. DataFrame operations only.

Scale: the texts are read once and leave one narrow row each (licence words with their places and what follows
them); all joins are on those. The index is a constant of this module, so its size is bounded and it is broadcast.
A line that stands in a third of all files costs rows in proportion to those files; document frequencies are
combined before they are shuffled.

Defined results: a null text is empty, has no words, no labels and score 0; overlapping base phrases all count;
repeated rows are scanned once each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import ascii_lower, stored, text_of, work_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: phrases that count as base places, and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Which word of a base phrase it is looked up by.
RAREST = {"under the mit license": 2, "apache license version 2": 0, "cc by nc": 0}

# fixed values: wordings of public licence notices, by label
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
]
# fixed values: a template counts only with one of its label's phrases
MANDATORY = {
    "mit": ["mit license", "granted free of charge"],
    "apache-2": ["apache license version 2"],
    "gpl-2": ["gnu general public license version 2"],
    "gpl-3": ["gnu general public license version 3"],
    "lgpl-3": ["gnu lesser general public license"],
    "agpl-3": ["gnu affero general public license"],
    "mpl-2": ["mozilla public license"],
    "bsd": ["redistribution and use in source"],
    "isc": ["distribute this software for any purpose"],
    "cc0": ["cc0 1 0"],
    "cc-by": ["creative commons attribution 4"],
    "cc-by-sa": ["cc by sa"],
    "cc-by-nc": ["cc by nc", "commons attribution noncommercial"],
}
# fixed values: words too common in any text to be looked up
COMMON = frozenset("a and any are by for fee files in is of or person purpose subject terms the this to under use v with without 0 1 2 3 4".split())

FOLLOWING = 6
SHARE = 0.6

INDEX = [(t, label, k, w) for t, (label, text) in enumerate(TEMPLATES) for k, w in enumerate(text.split()) if w not in COMMON]
VOCABULARY = sorted({w for *_, w in INDEX} | {p.split()[0] for ps in MANDATORY.values() for p in ps})


def _phrase_at(x: Column, phrase: str) -> Column:
    """Whether a phrase begins at the licence word x."""
    first, *rest = phrase.split()
    return reduce(lambda a, b: a & b, [F.get(x["next"], k) == w for k, w in enumerate(rest)], x["w"] == first)


def _base_places(phrase: str) -> Column:
    """(place, label) of a base phrase, from its rarest word: array column."""
    words, rare = phrase.split(), RAREST[phrase]

    def stands(x: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get("words", (x["i"] + (k - rare)).cast("int")) == w for k, w in enumerate(words)], (x["w"] == words[rare]) & (x["i"] >= rare))

    return F.transform(F.filter("found", stands), lambda x: F.struct((x["i"] - rare).alias("i"), F.lit(BASE[phrase]).alias("label")))


def licence_words(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, row, n_words, found: every licence word (place, word, the words after it), and base: (place, label)."""
    spark = docs.sparkSession
    words = docs.select(*keep, F.regexp_extract_all(ascii_lower(text_of(docs)), F.lit(WORD), 0).alias("words"))
    known = words.withColumn(
        "found",
        F.filter(
            F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.cast("long").alias("i"), w.alias("w")))),
            lambda x: x.isNotNull(),
        ),
    )
    full_base = F.concat(*[_base_places(phrase) for phrase in BASE])
    full = known.select(
        *keep,
        F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.transform("found", lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.slice(F.col("words"), (x["i"] + 2).cast("int"), FOLLOWING).alias("next"))).alias("found"),
        full_base.alias("base"),
    )
    return stored(full, work_dir(spark, "licence-words"))


def index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEX, "template int, label string, place long, w string")


def templates_found(files: DataFrame) -> DataFrame:
    """row, label, share: the labels whose template stands in a file, of the rows of licence_words."""
    spark = files.sparkSession
    n = files.count()
    seen = files.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.i", "x.w", "x.next")
    df = seen.select("row", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # one row for each word of VOCABULARY at most
    weights = {r.w: r.df for r in df.collect()}
    idf = spark.createDataFrame([(w, float(max(0.05, math.log((n + 1) / (weights.get(w, 0) + 0.5))))) for w in VOCABULARY], "w string, idf double")
    postings = index(spark).join(F.broadcast(idf), "w")
    votes = seen.join(F.broadcast(postings), "w").groupBy("row", "template", "label", (F.col("i") - F.col("place")).alias("offset")).agg(F.sum("idf").alias("got"))
    total = postings.groupBy("template").agg(F.sum("idf").alias("all"))
    # both sides are constants of this module
    shares = votes.join(F.broadcast(total), "template").withColumn("share", F.least(F.lit(1.0), F.col("got") / F.col("all"))).where(F.col("share") >= SHARE)
    best = shares.groupBy("row", "label").agg(F.max("share").alias("share"))
    word = {"w": F.col("w"), "next": F.col("next")}
    stands = [F.when(reduce(lambda a, b: a | b, [F.coalesce(_phrase_at(word, p), F.lit(False)) for p in ps]), F.lit(label)) for label, ps in MANDATORY.items()]
    phrases = seen.select("row", F.explode(F.array_compact(F.array(*stands))).alias("label"))
    return best.join(phrases.distinct(), ["row", "label"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    files = licence_words(docs)
    found = templates_found(files).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    none = F.array().cast("array<string>")
    return files.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["i"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["i"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("own", none)))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
