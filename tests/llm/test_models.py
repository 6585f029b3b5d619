"""Operators without a contract in SQL: against a library, a plain version or held-out labels."""

import random

import numpy as np

from tidegraph.llm import decontamination, html_text, token_count, toxicity


def test_token_counts_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("▁", -1.0), ("ba", -2.0), ("▁a", -2.0), ("bab", -4.0), ("xy", -3.0)]
    for vocabulary, fallback, letters in ((small, False, "abxyz ▁"), (token_count.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), True, "abcZ éß \n\t.,!12▁ ½日本 the ing<s>\x00𐍈")):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
        count, r = token_count.Counter(vocabulary, memo=40), random.Random(1)
        for _ in range(2000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
            assert count(text) == len(t.encode(text).ids), text


def best_alignment(item, passage):
    """Smith-Waterman in full."""
    best, row = 0.0, [0.0] * (len(passage) + 1)
    for w in item:
        new = [0.0]
        for k, v in enumerate(passage):
            new.append(max(0.0, row[k] + (1.0 if v == w else -0.5), row[k + 1] - 0.5, new[k] - 0.5))
        row = new
        best = max(best, *row)
    return best


def test_alignment():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        assert decontamination.align(np.array(a), np.array(b))[0] == best_alignment(a, b)


def noise(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_decontamination_finds_edited_copies(spark):
    r = random.Random(3)
    items = [(k, noise(r, 30)) for k in range(20)]
    docs, want = [], set()
    for d in range(80):
        body = [noise(r, r.randint(20, 80))]
        if d % 2:
            words = items[d % 20][1].split()
            for k in r.sample(range(30), 4 if d % 4 == 1 else 0):
                words[k] = "changed"
            body.append(" ".join(words))
            want.add((d, d % 20))
        docs.append((d, " ".join([*body, noise(r, 20)])))
    frame = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    for chars in (8_000_000, 1000):
        got = decontamination.contaminated(frame, bench, block_chars=chars).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
        assert all(x.score == 1.0 for x in got if x.doc_id % 4 == 3)
    kept = decontamination.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs if d % 2 == 0} | {900, 901}


def test_toxicity_holds_out(spark):
    r = random.Random(4)
    bad = "moron scum idiot clown".split()
    rows = []
    for d in range(900):
        words = noise(r, 40).split()
        if d % 5 == 0:
            words[3:3] = r.sample(bad, 3)
        rows.append((d, " ".join(words), int(d % 5 == 0)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(5002, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    scored = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == 902 and all(0 <= s <= 1 for s in scored.values())
    hits = sum((scored[d] >= 0.7) == bool(y) for d, _, y in rows)
    assert hits >= 0.97 * len(rows)
    kept = toxicity.without_toxic(docs.selectExpr("doc_id", "text", "1 AS score"), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 650 <= kept.count() <= 760


def test_visible_text():
    page = """<html><head><title>t</title><body><h1>Head</h1><p>One <b>two</b>
 three<p>Four<br>five<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol><table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>long cell here</table>after<div hidden>no</div><span style="display: none">no</span><pre>  a
   b</pre>end &amp; &lt;done&gt; <img alt="pic"> 1 < 2<script>var t="</p>";</script>"""
    assert html_text.visible_text(page) == (
        "Head\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n  - c\n- d\n\n3. x\n4. y\n\nCap\nName  | Qty\napple | 3\nlong cell here\n\nafter\n\n  a\n   b\n\nend & <done> pic 1 < 2"
    )
    for odd in ("", None, "<", "</p>", "<<<>>>", "<!--", "<a href='", "<table><td>", "<li>", "</div></div>", "<div>" * 20_000):
        html_text.visible_text(odd)
    assert html_text.visible_text("<p>a</p><!-- <p>b</p> --><p style='visibility:hidden'>c</p>d") == "a\n\nd"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (2, ""), (3, "x")], "page_id long, html string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == [(1, "a\n\nb"), (2, ""), (2, ""), (3, "x")]


def test_items_of_common_or_few_words(spark):
    """Items without a rare n-gram are held against a plain alignment with every document."""
    r = random.Random(7)
    words = ["the", "of", "and"]
    item = " ".join(r.choice(words) for _ in range(40))
    edited = item.split()
    edited[20] = "changed"
    docs = [(d, " ".join(r.choice(words) for _ in range(20))) for d in range(10)] + [(10, f"and of {item} the"), (11, "of of the"), (12, " ".join(edited)), (13, noise(r, 30)), (14, "a zygomorphic b"), (15, "c quinquennial")]
    tests = [(1, item), (2, "the of"), (3, "zygomorphic"), (4, "zygomorphic quinquennial"), (5, "the and zygomorphic of"), (2, "the of"), (6, "The of!")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x.score for x in found}
    assert len(got) == len(found) and got[10, 1] == 1.0 and got[12, 1] > 0.9
    want = {}
    for i, t in dict(tests).items():
        own = decontamination.byte_words(t)
        for d, text in docs:
            score = best_alignment(own, decontamination.byte_words(text)) / len(own)
            if i != 1 and score >= 0.5:
                want[d, i] = score
    assert {k: v for k, v in got.items() if k[1] != 1} == want and len(want) > 20


def test_copies_with_many_edits_are_found(spark):
    """Of copies that align at 0.5 or above, nearly all are found, though seeds are exact."""
    r = random.Random(9)
    vocabulary = [noise(r, 1) + str(k) for k in range(2000)]
    draw = lambda n: [vocabulary[min(1999, int(2000 * r.random() ** 3))] for _ in range(n)]
    items = [(k, draw(30)) for k in range(60)]
    docs, want = [], set()
    for d in range(300):
        i, own = items[d % 60]
        own = [w if r.random() > 0.04 * (d // 60) + 0.1 else draw(1)[0] for w in own]
        docs.append((d, " ".join([*draw(60), *own, *draw(60)])))
        if best_alignment(items[d % 60][1], own) >= 15:
            want.add((d, i))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert len(want) > 200 and len(got & want) >= 0.99 * len(want)


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (7, item, 3), (7, "clean", 4)], "doc_id long, text string, text_ int")
    kept = decontamination.without_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(x.text_ for x in kept.collect()) == [2, 4]


def test_what_a_page_shows():
    page = """<style>.x{display:none} #y{visibility:hidden} @media print{p{display:none}}</style><p>a<p class='x z'>no</p><div id=y>no<b style='visibility:visible'>yes</b>no</div>
<details><summary>s</summary>no</details><dialog>no</dialog><p aria-hidden=true>b<select><option>o1<option>o2</select><svg><text>t</text></svg>"""
    assert html_text.visible_text(page).split() == ["a", "yes", "s", "b", "o1", "o2", "t"]


def test_tables_stay_in_proportion():
    wide = "<table><tr><td>" + "x" * 20_000 + "</td><td>a</td></tr>" + "<tr><td>a<td>b</tr>" * 2000 + "</table>"
    long = "<table><tr>" + "<td>a" * 1000 + "<td>" + "x<br>" * 20_000 + "</table>"
    spanned = "<table><tr>" + "<td>a" * 1000 + "</tr>" + "<tr><td colspan=999>a<td>b</tr>" * 2000 + "</table>"
    for page in (wide, long, spanned):
        assert len(html_text.visible_text(page)) < 250 * page.count("<td") + len(page)
