r"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, ip addresses, card and phone numbers; these are the seed entities. Looser shapes give
candidates: strings that look like an identifier but that no base pattern took (a phone number without its plus, an
email written with "at", a card number with a wrong digit). Every occurrence of either has several lexical patterns, from
narrow to wide: the two words in front of it, the one in front, the one behind, both sides together, and its own shape;
digits count as one sign in all of them. Patterns and instances form a bipartite graph. Confidence goes back and forth
over its edges for a few rounds: a pattern is as good as the share of its occurrences that are trusted, an unknown
instance as good as the mean of its patterns that enough different seeds stand behind, seeds stay certain. Candidates
with a high-confidence pattern, other than the word behind alone, are then spans of the kind of their best one, if their digits allow that kind. Base spans
always stay.

DataFrame operations only. Places come from the gaps and matches of one regular expression, as code points. None of
the expressions repeats a group, so runs of any length take no stack: separators that a match may contain are first
replaced, one for one, by private marks, which makes each match a plain run.

Scale: texts are read once and leave one narrow row each; the graph's edges are counts of distinct (pattern,
instance) pairs, combined before they are shuffled, so a phrase or an entity in a third of all rows is one edge.
Scores are joined, never collected.

Defined results: a null text is empty and has no spans; repeated rows are each reported; a candidate that overlaps a
base span is dropped; of patterns with equal confidence the kind named first wins; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import release, stored, text_of, work_dir

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, CONFIDENT, SUPPORT = 4, 0.6, 3
#: Characters on either side of an entity that its patterns are taken from; of a longer word they hold the near end.
CONTEXT = 48

# private marks: a dot within a domain, a separator within digits; the same marks in a text become the third
DOT, JOIN, OTHER = "", "", ""
_LOCAL = f"A-Za-z0-9._%+{DOT}-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
DIGITS = f"[0-9][0-9{JOIN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[(\[] ?at ?[)\]] ?|@)[A-Za-z0-9-]++(?:(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z0-9-]++)*+"
LOOSE_NUMBER = r"(?<![0-9A-Za-z.+@-])\(?[0-9][0-9() .-]*+(?:(?<=[() .-])|(?![0-9A-Za-z@]))"


def places(text: Column, pattern: str) -> Column:
    """The matches of a pattern: array of (start, end, text), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["text"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), x["text"].alias("text"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def n_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def luhn(s: Column) -> Column:
    digits = F.reverse(F.regexp_replace(s, "[^0-9]", ""))

    def step(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _trimmed(found: Column) -> Column:
    """Matches without the separators at their end."""
    cut = lambda x: F.regexp_replace(x["text"], "[() .-]++$", "")
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(cut(x))).alias("end"), cut(x).alias("text")))


def _kind(found: Column, kind: str, base: bool) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"), x["text"].alias("text")))


SPAN = "array<struct<start:int,kind:int,end:int,base:boolean,text:string>>"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans: base spans and candidates of every row, with the patterns and the value of each; written."""
    t = F.col("t")
    none = F.array().cast(SPAN)
    raw = docs.select("doc_id", text_of(docs).alias("t"))
    marks = F.when(t.rlike(f"[{DOT}-{OTHER}]"), F.regexp_replace(t, f"[{DOT}-{OTHER}]", OTHER)).otherwise(t)
    # length-preserving: what is found in these stands at the same places in the text
    seen = raw.withColumn("m", marks).withColumn("has_at", F.contains("m", F.lit("@"))).withColumn("has_digit", F.col("m").rlike("[0-9][0-9(). -]{5}"))
    seen = seen.withColumn("dots", F.when(F.col("has_at"), F.regexp_replace("m", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)))
    seen = seen.withColumn("joined", F.when(F.col("has_digit"), F.regexp_replace("m", r"(?<=[0-9])[ -](?=[0-9])", JOIN)))
    email = F.when(F.col("has_at"), _kind(places(F.col("dots"), EMAIL), "email", True)).otherwise(none)
    ip = F.when(F.col("has_digit"), _kind(F.filter(places(F.col("m"), IP), lambda x: x["text"].rlike(OCTETS)), "ip", True)).otherwise(none)
    card = F.when(F.col("has_digit"), _kind(F.filter(places(F.col("joined"), DIGITS), lambda x: n_digits(x["text"]).between(12, 19) & luhn(x["text"])), "card", True)).otherwise(none)
    phone = F.when(F.col("has_digit") & F.contains("m", F.lit("+")), _kind(F.filter(places(F.col("m"), PHONE), lambda x: n_digits(x["text"]).between(9, 15)), "phone", True)).otherwise(none)
    loose = F.when(F.col("has_digit"), _kind(F.filter(_trimmed(places(F.col("m"), LOOSE_NUMBER)), lambda x: n_digits(x["text"]).between(7, 19)), "phone", False)).otherwise(none)
    at = F.col("m").rlike(r"[(\[] ?at ?[)\]]|@")
    mail = F.when(at, _kind(places(F.col("m"), LOOSE_EMAIL), "email", False)).otherwise(none)
    seen = seen.select("doc_id", "t", F.concat(email, ip, card, phone).alias("own"), F.concat(mail, loose).alias("more"))
    free = F.filter("more", lambda x: ~F.exists("own", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    seen = seen.withColumn("all", F.concat("own", free))

    def shape(x: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT, F.lit(0))
        digits = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "9")
        before = F.split(F.rtrim(digits(F.regexp_replace(F.substr(F.col("t"), first + 1, x["start"] - first), r"\s+", " "))), " ")
        behind = F.get(F.split(F.ltrim(digits(F.regexp_replace(F.substr(F.col("t"), x["end"] + 1, F.lit(CONTEXT)), r"\s+", " "))), " "), 0)
        last, second = F.element_at(before, -1), F.try_element_at(before, F.lit(-2))
        form = F.regexp_replace(digits(F.translate(x["text"], DOT + JOIN, ". ")), "[a-z]+", "a")
        tagged = lambda tag, c, *needed: F.when(reduce(lambda a, b: a & b, [F.coalesce(n != "", F.lit(False)) for n in needed]), F.concat(F.lit(tag), c))
        patterns = F.array_compact(F.array(
            tagged("2:", F.concat_ws(" ", second, last), second, last), tagged("1:", last, last), tagged("r:", behind, behind),
            tagged("b:", F.concat_ws(" _ ", last, behind), last, behind), tagged("s:", form, form),
        ))
        value = F.regexp_replace(F.lower(F.translate(x["text"], DOT + JOIN, ".")), r"[\s()\[\]-]", "")
        numbers = F.when(x["kind"] == 0, 0).otherwise(n_digits(x["text"])).cast("int")
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), patterns.alias("patterns"), F.xxhash64(value).alias("value"), numbers.alias("digits"))

    out = seen.select("doc_id", F.monotonically_increasing_id().alias("row"), F.transform("all", shape).alias("spans"))
    return stored(out, work_dir(docs.sparkSession, "pii"))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, confidence, of the rows of occurrences()."""
    spark = found.sparkSession
    base = work_dir(spark, "pii-graph")
    spans = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.value", "s.kind", "s.base")
    edges = stored(spans.groupBy("pattern", "value", "kind", "base").agg(F.count(F.lit(1)).alias("n")), f"{base}/edges")
    backed = edges.where("base").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= support)
    # only patterns that enough different seeds stand behind can become confident
    backed = stored(backed, f"{base}/backed")
    size = edges.groupBy("pattern").agg(F.sum("n").alias("size"))
    trusted = edges.where("base").select("value", "kind", F.lit(1.0).alias("trust")).distinct()
    unknown = edges.where("NOT base").select("pattern", "value", "n")
    scores = None
    tables = []
    for k in range(rounds):
        weight = edges.join(trusted.withColumnRenamed("kind", "as"), "value").groupBy("pattern", F.col("as").alias("kind")).agg(F.sum(F.col("n") * F.col("trust")).alias("weight"))
        scores = weight.join(backed, ["pattern", "kind"]).join(size, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("weight") / F.col("size")).alias("confidence"))
        scores = stored(scores, f"{base}/scores-{k}")
        tables.append(f"{base}/scores-{k}")
        spread = unknown.join(scores, "pattern").groupBy("value", "kind").agg((F.sum(F.col("n") * F.col("confidence"))).alias("got"))
        # what is shared out over its patterns that have a score at all
        total = unknown.join(scores.select("pattern").distinct(), "pattern", "left_semi").groupBy("value").agg(F.sum("n").alias("n"))
        guessed = spread.join(total, "value").select("value", "kind", F.least(F.lit(1.0), F.col("got") / F.col("n")).alias("trust"))
        trusted = edges.where("base").select("value", "kind", F.lit(1.0).alias("trust")).distinct().unionByName(guessed).groupBy("value", "kind").agg(F.max("trust").alias("trust"))
    out = stored(scores.where(F.col("confidence") >= confident).withColumn("rank", F.max("confidence").over(_best())).where("rank = confidence").drop("rank"), f"{base}/confident")
    release(spark, f"{base}/edges", f"{base}/backed", *tables)
    return out


def _best():
    from pyspark.sql import Window as W

    return W.partitionBy("pattern")


def scan(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """doc_id, row, spans of every row: array of (start, kind, end, base), sorted by start, then kind."""
    found = occurrences(docs)
    patterns = confident_patterns(found, rounds, confident, support).select("pattern", F.col("kind").alias("as"), "confidence")
    some = found.where(F.exists("spans", lambda x: ~x["base"])).select("row", F.explode("spans").alias("s")).where("NOT s.base")
    # the word behind alone tells too little: it only speaks for an instance, in confident_patterns()
    each = some.select("row", "s.start", "s.end", "s.kind", "s.digits", F.explode("s.patterns").alias("pattern")).where("NOT startswith(pattern, 'r:')")
    # a loose email can only be an email; loose digits take the kind of their best pattern that their number allows
    allowed = F.when(F.col("kind") == 0, F.col("as") == 0).otherwise((F.col("as") == 2) & F.col("digits").between(12, 19) | (F.col("as") == 3) & F.col("digits").between(7, 15))
    hits = each.join(patterns, "pattern").where(allowed).groupBy("row", "start", "end").agg(F.max_by("as", F.struct("confidence", -F.col("as"))).alias("as"))
    new = hits.groupBy("row").agg(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end", F.lit(False).alias("base"))).alias("new"))
    own = F.transform(F.filter("spans", lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base")))
    every = F.array_sort(F.concat(own, F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>"))))
    return found.join(new, "row", "left").select("doc_id", "row", every.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of the method too), of the rows of scan()."""
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
