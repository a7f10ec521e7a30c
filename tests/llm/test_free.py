"""Operators without a contract, and odd rows."""

import html as std

import pytest
from pyspark.sql import functions as F

from spectrafold.llm import html, licenses, packing, quality, sharding, toxicity
from spectrafold.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    held = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    english = {"idiot", "pathetic", "loser", "scum", "moron", "worthless", "clown", "disgusting", "trash", "stupid"}
    texts = {r.doc_id: set(toxicity.word_counts(r.text)) for r in docs.collect()}
    marked = [r for r in held if r.toxic and texts[r.doc_id] & english]
    assert sum(r.rejected for r in marked) >= 0.95 * len(marked)
    clean = [r for r in held if not r.toxic]
    assert sum(r.rejected for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.expected_severity <= 3 for r in held)


def test_toxicity_held_out_recall_of_each_language(spark):
    """Over all toxic texts, whatever their words; stems that clean texts hold once count, too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.filter("toxic in (0, 1)")
    for held in (0, 1):
        model = toxicity.train(docs, labels.filter(f"doc_id % 2 != {held}"))
        rows = toxicity.score(docs, model).join(labels.filter(f"doc_id % 2 = {held}"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
        for lang in ("en", "de", "es", "fr"):
            toxic = [r.rejected for r in rows if r.lang == lang and r.toxic]
            clean = [r.rejected for r in rows if r.lang == lang and not r.toxic]
            assert sum(toxic) >= 0.85 * len(toxic) > 0, lang
            assert sum(clean) <= 0.03 * len(clean), lang


def test_toxicity_levels():
    """A stem that every clean text holds once and every toxic one three times."""
    rows = [({"fooling": 1, f"a{i}": 1}, 0) for i in range(40)] + [({"fooling": 3, f"b{i}": 1}, 1) for i in range(20)]
    model = toxicity.fit(rows, [t for _, t in rows])
    assert [model.severity(t, {})[1] > 0.5 for t in ("fooling", "fooling fooling fooling", None)] == [False, True, False]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "you idiot", 3.0)], "doc_id long, text string, p_toxic double")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.thresholds == [] and [r.expected_severity for r in toxicity.score(docs, none).collect()] == [0.0] * 3
    model = toxicity.Model({"idiot": 3.0}, [1.0, 2.0])
    assert {r.doc_id: r.rejected for r in toxicity.score(docs, model).collect()} == {1: False, 2: False, None: True}
    assert [r.doc_id for r in toxicity.drop_toxic(docs, model).orderBy("doc_id").collect()] == [1, 2]


def test_licenses(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    mit = licenses.KNOWN[0][1]
    other = "Copyright (c) 2019 A. Person\n\n" + mit.upper().replace("SUBLICENSE", "sublicence").replace(" AND ", "\n   and ").replace(".", " . ")
    rows = [(1, mit), (2, other), (3, mit + " But not on Sundays."), (4, None), (5, ""), (6, "Text.\nReleased under the MIT licence!\nMore."), (6, "Text."), (None, licenses.KNOWN[1][1])]
    got = {(r.doc_id, r.license, tuple(r.paragraph_licenses)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", ()), (2, "MIT", ()), (3, None, ()), (4, None, ()), (5, None, ()), (6, None, ("MIT",)), (6, None, ()), (None, "ISC", ())}


def test_license_query_against_plain_lines(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.paragraph_licenses for r in Q.op6_license_scan(spark, SF).collect()}
    lines = {t.strip(): n for n, t in licenses.KNOWN}
    assert got == {i: ",".join(sorted({lines[x] for x in t.split("\n") if x in lines})) for i, t in docs.items()}
    assert any(got.values())


PAGE = """<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><a href=a>m</a></nav>
<div class="cookie-notice">We use cookies, really, many, of, them</div>
<div id=main-text><h1>Title &amp; more</h1><p>One, two,   three<br>four &lt;b&gt; <a href=x>link</a>.<p>Second <b>bold</b> par&eacute;.
<ul><li>item</li><li>thing</ul><script>var a = "</p><p>no</p>";</script><form><p>Form, text, here</p></form>
<p>Short</div><div class="comments"><p>Nice, very, nice, post, I, say</p></div><aside><p>side, bar, text</p></aside><footer>f</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Title & more\nOne, two, three four <b> link.\nSecond bold paré.\nitem\nthing\nShort"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""
    assert html.main_text("just text, no tags") == "just text, no tags"
    deep = "<div>" * 20000 + "<p>deep text, here</p>"
    assert html.main_text(deep) == "deep text, here"


def test_html_query(spark):
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op9_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        parts = (" ".join(std.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_extra_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", "clash", 5)], "page_id long, html string, text string, n_chars long")
    assert [tuple(r) for r in html.extract(rows).collect()] == [(1, "a", 1)]


def test_html_points_decide_and_names_spare_paragraphs():
    page = "<main><article><div class=alert>Pay attention, now</div><p class=legal>Legal, text, here.</p><p class='share'>We share, it.</p><div class='share-buttons'><a href=x>tweet</a></div></article><div class=related><p>other, story</p></div></main>"
    assert html.main_text(page) == "Pay attention, now\nLegal, text, here.\nWe share, it."
    assert html.main_text("<p>a, b</p><svg viewBox='0'/><p>c, d</p><video src=x><p>e, f</p>") == "a, b\nc, d\ne, f"


@pytest.mark.parametrize("page", ["<a " * 60_000, "<p x='" * 60_000, "<p x=\"'" * 60_000, "<!" * 60_000, "<div>" * 30_000 + "<p>t, u</p>" * 30_000, "<div>" * 30_000 + "</x>" * 30_000, "<video>" * 60_000, "<script>" * 60_000, "<p>" * 60_000, "<x>" * 30_000 + "<li>l" * 30_000])
def test_html_is_linear_in_bad_pages(page):
    import time

    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 8


def test_spellings_in_a_row(spark):
    row = spark.createDataFrame([("Licence licence LICENCE, the Copyright holder.",)], "t string").select(licenses.canonical(F.col("t"))).first()
    assert row[0] == "license license license the copyright owner"


def test_slot_maps_are_versions_and_rebalancing_moves_little(spark, tmp_path):
    recs = sharding.records(spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod("id", F.lit(97)).cast("int")).alias("text")))
    slots = sharding.slot_table(recs)
    path = f"{tmp_path}/maps"
    sharding.save_map(sharding.build_map(slots, 16), path)
    one = sharding.load_map(spark, path)
    sharding.save_map(sharding.rebalance(one, slots, 17), path)
    two = sharding.load_map(spark, path)
    a, b = ({r.virtual_slot: (r.shard, r.bytes) for r in m.collect()} for m in (one, two))
    assert {r.version for r in two.collect()} == {2} and sharding.load_map(spark, path, 1).count() == one.count() and set(a) == set(b)
    load = lambda m, n: [sum(x for s, x in m.values() if s == k) for k in range(n)]
    most = max(x for _, x in a.values())
    assert max(load(a, 16)) - min(load(a, 16)) <= most and max(load(b, 17)) - min(load(b, 17)) <= 2 * most
    moved = sum(x for k, (s, x) in b.items() if a[k][0] != s)
    assert moved <= 1.3 * sum(x for _, x in b.values()) / 17
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(two, path)
    gone = {r.virtual_slot: r.shard for r in sharding.rebalance(two, slots, 15).collect()}
    assert set(gone.values()) == set(range(15)) and set(gone) == set(a)


def test_empty_tables_nulls_ties_and_long_texts(spark):
    """Operators that the other tests don't see on such rows."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert packing.pack(none, path).collect() == [] and licenses.scan(none).collect() == [] and quality.counts(none).collect() == []
    recs = sharding.records(none)
    assert sharding.assign(recs, sharding.build_map(sharding.slot_table(recs), 16)).collect() == []
    assert toxicity.score(none, toxicity.Model({"x": 1.0}, [1.0])).collect() == []
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
    long = "word " * 200_000 + "end"
    rows = [(1, long, "en"), (1, long, "en"), (2, None, None), (None, "", "en"), (None, "", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(-1)).withColumn("virtual_slot", F.lit(1))
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in quality.counts(frame).collect()) == [(0, 0, 0), (0, 0, 0), (1, 200_001, 200_000), (1, 200_001, 200_000), (2, 0, 0)]
    got = sharding.assign(sharding.records(frame), sharding.build_map(sharding.slot_table(sharding.records(frame)), 2)).collect()
    assert len(got) == 5 and len({(r.shard, r.place) for r in got}) == 5 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert [r.license for r in licenses.scan(frame).collect()] == [None] * 5
    assert len(toxicity.score(frame, toxicity.Model({"word": 1.0}, [1.0])).filter("grade = 1").collect()) == 2
    pieces = packing.pack(frame, path).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)


def test_encoder_on_odd_texts():
    """Ids of the fast path are those of the tokenizer."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(6)
    bits = ["a", "word", "Word's", "'ll", " ", "  ", "\t", "\n", "\u00a0", "\u3000", "\u200b", "e\u0301", "\u0301", "12", "3,4", "!?", "...", "\U0001f600\u200d", "\u4e2d\u6587", "\u0645", "\x00", "\x1f", "\ufffd", *enc.special, "caf\u00e9."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for t, ids in zip(texts, enc.encode(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == b"".join(x.to_bytes(4, "little") for x in want), repr(t)
