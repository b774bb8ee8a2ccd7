"""Rules, classifiers, encoding and extraction."""

import itertools
import random

import public_tokenizers
import pytest
import reference
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import ftrl, importance, langid, mincut, pieces

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "É à 漢字 ZZZ"), (904, "x" * 3000), (905, "one line\none line\n\none line")]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_quality_measures_equal_plain_python(spark, documents, labels):
    repeated = [(910, " ".join(["a b c d e f"] * 4)), (911, "u v w x y z u v w x y"), (912, "k k k k k k")]
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()] + ODD + repeated
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("hashes", F.lit(1)).withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in importance.quality_rules(frame, labels.filter("quality = 1")).collect()}
    for d, text in rows:
        want = reference.base_quality(text)
        assert tuple(got[d][1:6]) == want
        assert got[d].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[d].base_failed and got[d].kept)
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert all(got[d].kept for d, q in good.items() if q == 1 and not got[d].base_failed)
    assert not any(got[d].kept for d, q in good.items() if q == 0)


def test_quality_weights_equal_a_direct_count(spark, documents, labels):
    trusted = labels.filter("quality = 1").select("doc_id")
    bins = importance.gram_rows(importance._with_hashes(documents, "doc_id"), 64, "doc_id").groupBy("doc_id").agg(F.collect_list("bin").alias("g")).collect()
    good = {r[0] for r in trusted.collect()}
    raw, target = [0] * 64, [0] * 64
    for d, grams in bins:
        for g in grams:
            raw[g] += 1
            target[g] += d in good
    counted = {r["bin"]: (r["raw"], r["target"]) for r in importance.bin_counts(documents, trusted, 64).collect()}
    assert counted == {k: (raw[k], target[k]) for k in range(64) if raw[k]}


def test_quality_scores_equal_plain_python(spark, documents, labels):
    """Weights, back-off and mean from each text's words; only the hashes are Spark's."""
    import re
    from math import log
    from statistics import median

    bins = 512
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()] + ODD + [(0, "repeated id " * 9)]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    words = {w for _, t in rows for w in reference.WORDS.findall(t or "")}
    shape = lambda w: re.sub(r"([aA0])\1+", r"\1", "".join("a" if c.islower() and c.isalpha() else "A" if c.isupper() else "0" if c.isdecimal() else c for c in w))
    texts = sorted(words | {shape(w) for w in words})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in texts], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(a, b) for _, t in rows for a, b in itertools.pairwise(reference.WORDS.findall(t or ""))})
    frame = spark.createDataFrame([(i, hashed[b], hashed[a], hashed[shape(b)], hashed[shape(a)], a == b) for i, (a, b) in enumerate(pairs)], "i int, b long, a long, sb long, sa long, same boolean")
    both = {pairs[r.i]: (r.own, r.shape) for r in frame.select("i", F.xxhash64("b", "a").alias("own"), F.xxhash64("sb", "sa", "same").alias("shape")).collect()}
    at_pairs, at_shapes = bins * 3 // 8, bins * 7 // 8

    def grams(text):
        w = reference.WORDS.findall(text or "")
        out = [(hashed[x] % at_pairs, at_shapes + hashed[shape(x)] % (bins - at_shapes)) for x in w]
        return out + [(at_pairs + both[p][0] % (at_shapes - at_pairs), at_shapes + both[p][1] % (bins - at_shapes)) for p in itertools.pairwise(w)]

    raw, target = [0] * bins, [0] * bins
    for d, text in rows:
        for g in itertools.chain.from_iterable(grams(text)):
            raw[g] += 1
            target[g] += d in trusted
    weight = [None] * bins
    for start, end in ((0, at_pairs), (at_pairs, at_shapes), (at_shapes, bins)):
        rate, load = sum(target[start:end]) / sum(raw[start:end]), 4 * median(raw[start:end])
        for k in range(start, end):
            if end == bins or (raw[k] >= load and max(target[k], raw[k] * rate) >= 8):
                weight[k] = log((target[k] + 0.5) / (raw[k] * rate + 0.5))
    assert any(w is not None for w in weight[:at_shapes])
    got = {(r.doc_id, r.n_words): r for r in importance.quality_rules(spark.createDataFrame(rows, SCHEMA), labels.filter("quality = 1"), bins).collect()}
    for d, text in rows:
        said = [weight[shape_bin] if weight[own] is None else weight[own] for own, shape_bin in grams(text)]
        r = got[d, len(reference.WORDS.findall(text or ""))]
        assert r.score == pytest.approx(sum(said) / len(said) if said else 0.0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= importance.THRESHOLD)


def test_trusted_documents_are_bounded(spark):
    ids = spark.createDataFrame([(d % 50 if d % 7 else None,) for d in range(200)], "doc_id long")
    few = [r.doc_id for r in importance.trusted_sample(ids, 10).collect()]
    assert len(few) == len(set(few)) == 10 and None not in few


def test_quality_looks_at_words(spark):
    pick = random.Random(11)
    prose, spam = ("the river ran past a small town where people met each morning to talk".split(), "buy cheap pills now casino bonus win cash click free offer today here".split())
    text = lambda words: " ".join(pick.choice(words) for _ in range(40))
    rows = [(d, text(spam if d % 3 == 0 else prose)) for d in range(300)] + [(1000, text(spam)), (1001, text(prose)), (1002, text(["unheard", "words"])), (None, text(prose))]
    trusted = spark.createDataFrame([(d,) for d in range(300) if d % 3 == 1] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in importance.quality_rules(spark.createDataFrame(rows, SCHEMA), trusted).collect()}
    assert not any(got[d].kept for d in (*range(0, 300, 3), 1000))
    assert got[1001].score > 0 > importance.THRESHOLD > got[1000].score
    assert all(got[d].score > 0 for d in range(300) if d % 3)
    assert abs(got[1002].score) < 0.1  # not found in the corpus: by shape alone


def test_quality_of_nothing(spark, labels):
    empty = spark.createDataFrame([], SCHEMA)
    assert importance.quality_rules(empty, labels.limit(0)).collect() == []
    alone = importance.quality_rules(spark.createDataFrame([(1, "a b c d e f g h i j k")], SCHEMA), labels.limit(0)).first()
    assert alone.kept and alone.score == 0.0


def test_passing_documents_keep_their_columns(spark, documents, labels):
    frame = documents.withColumn("score", F.lit("s"))
    kept = importance.passing_documents(frame, labels.filter("quality = 1"))
    assert kept.columns == frame.columns and 100 < kept.count() < 200


def test_classifier_on_held_out_labels(spark, documents, labels):
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = ftrl.quality_scores(large[0], large[1].select("doc_id", F.col("quality").alias("label")))
    found = scored.filter("held_out").join(large[1], "doc_id").select("quality", "predicted").collect()
    assert len(found) > 80 and sum(q == p for q, p in found) >= 0.97 * len(found)


def test_classifier_odd_rows(spark, documents, labels):
    learn = labels.select("doc_id", F.col("quality").alias("label"))
    frame = spark.createDataFrame(ODD + ODD[:1], SCHEMA).withColumn("rank", F.lit(1)).withColumn("label", F.lit(None).cast("string"))
    model = ftrl.quality_scores(frame.unionByName(documents.select("doc_id", "text"), allowMissingColumns=True), learn)
    got = model.filter("doc_id >= 900").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = ftrl.quality_scores(frame, learn.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert ftrl.quality_scores(spark.createDataFrame([], SCHEMA), learn).collect() == []


def test_ftrl_separates():
    import numpy as np

    samples = [(np.array([i % 3]), np.array([1.0]), int(i % 3 == 0)) for i in range(300)]
    w, bias = ftrl.fit(samples, 4)
    assert w[0] + bias > 0 > w[1] + bias and w[3] == 0


def test_languages_on_held_out_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict_languages(frame).filter("held_out").join(frame, "doc_id").select("lang", "lang_pred").collect()
    assert len(found) > 200 and sum(a == b for a, b in found) >= 0.97 * len(found)


def test_languages_odd_rows(spark, documents):
    odd = [(d, t, None) for d, t in ODD] + [(906, "12 34!", "en"), (907, "abc", None)]
    frame = spark.createDataFrame(odd, SCHEMA + ", lang string").unionByName(documents.select("doc_id", "text", "lang")).withColumn("letter", F.lit(0))
    got = {r.doc_id: r for r in langid.predict_languages(frame).filter("doc_id >= 900").collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {900, 901, 902, 906}
    assert all(r.score == 0 if r.lang_pred == "und" else 0 < r.score <= 1 for r in got.values())
    nothing = langid.predict_languages(spark.createDataFrame(odd, SCHEMA + ", lang string").filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA + ", lang string")).collect() == []


def test_language_problems():
    names = [n for n, _ in langid.problems(["de", "en", "es", "fr", "xx"])]
    assert names == ["germanic", "only xx", "romance", "de|en", "es|fr"]


@pytest.fixture(scope="module")
def coder():
    return pieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(coder, text):
    ids, decoded = coder[0].encode(text)
    want = coder[1].encode(text, add_bos=True, add_eos=True)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, text
    assert decoded == coder[1].decode(want)
    assert coder[0].decode(want)[1:] == decoded or not text


def test_encoding_equals_the_library(coder, documents):
    for text in ["", " ", "   a", "a\n\nb", "▁x", "a\0b", "Ⅷ ﬁ", "😀👍🏽 é", "あ漢字 <s> </s> <0x0A>", " " * 40 + "x", "x" * 500, "²." * 9]:
        same(coder, text)
    pick = random.Random(7)
    signs = "abcdefghijklmnop     XYZ0123.,;:-_()[]{}<>/\\\n\téèüß漢字あ😀ж"
    tokens = list(coder[0].merges.ids)
    for _ in range(1500):
        same(coder, "".join(pick.choice(signs) for _ in range(pick.randint(1, 50))))
        same(coder, "".join(pick.choice(tokens) for _ in range(pick.randint(1, 10))))
    for r in documents.limit(40).collect():
        same(coder, r.text)


def test_encoding_survives_small_caches(coder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SPANS", 3)
    monkeypatch.setattr(pieces, "PAIR_CACHE", 5)
    for text in ("the cat sat on the mat " * 3, "unbelievable misunderstandings happen"):
        same(coder, text)


def test_encoding_table(spark):
    frame = spark.createDataFrame(ODD + ODD[:1], SCHEMA).withColumn("ids", F.lit("x"))
    got = pieces.encode_decode(frame, MODEL).collect()
    assert len(got) == 7 and all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 900} == {2}
    assert pieces.encode_decode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_minimum_cut_equals_all_labelings():
    pick = random.Random(3)
    for _ in range(300):
        n = pick.randint(1, 8)
        evidence = [pick.uniform(-2, 2) for _ in range(n)]
        joined = [(i, i + 1, pick.uniform(0, 2)) for i in range(n - 1)] + [(a, b, pick.random()) for a in range(n) for b in range(a + 1, n) if pick.random() < 0.2]

        def cost(labels, evidence=evidence, joined=joined):
            return sum(max(0, -e) if x else max(0, e) for e, x in zip(evidence, labels)) + sum(c for a, b, c in joined if labels[a] != labels[b])

        least = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(mincut.minimum_cut(evidence, joined)) == pytest.approx(least)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><ul class="menu"><li><a href=x>Home</a></ul></header>
<div class="cookie-notice">We use cookies to improve things a lot.</div><main><article><header><h1>Title  here</h1></header><p>First para&nbsp;with <i>in</i>line &lt;b&gt;.<p>Second,<br>short.
<aside>Related: foo</aside><div class="ad">Buy now!</div><form><label>Name</label><input><button>Go</button></form><p>Third &am</p></article>
<section id="comments"><h3>Comments</h3><p>Nice article, thank you for it! I enjoyed reading.</p></section></main><footer>&copy; 2024 x</footer><script>if (a<b) {"</p>"}</script></body></html>"""


def test_extraction(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<script>x"), (5, "u", "<p>A short but whole sentence stands here.<!-- x"),
             (6, "u", "<article>" + "<p>Word and word. " * 3000), (1, "u", PAGE)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = mincut.extract(frame).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows)
    assert got[1] == "Title here First para with inline <b>. Second, short. Third &am"
    assert (got[2], got[3], got[4], got[5]) == ("", "", "", "A short but whole sentence stands here.")
    assert got[6] == " ".join(["Word and word."] * 3000)
    assert mincut.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    ('<p>One sentence.</p><a href="x"">link</a><p>Two sentences.</p><p>Three of them.</p>', ["One sentence.", "link", "Two sentences.", "Three of them."]),
    ("<p title=it's>One sentence.</p><p>Two.</p>", ["One sentence.", "Two."]),
    ('<img alt="5" tall"><p>One.</p><p title="a>b">Two.</p>', ["One.", "Two."]),
    ('<p title="open>One.</p><p>Two.</p>', ["One.", "Two."]),
    ("<p title = 'a>b' x=\"c>d\"y>One.</p><p a=b=\"c>Two.</p><p title='it\"s'>Three.</p>", ["One.", "Two.", "Three."]),
])
def test_odd_quotes_swallow_no_text(page, want):
    assert [b.text for b in mincut.blocks(page)] == want


@pytest.mark.parametrize("wrapper", ["class='layout-sidebar-right'", "class='page-with-sidebar'", "class='legal-text'", "id='header-and-content'", "class='sidebar'", "class='widget'"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_do_not_lose_the_article(wrapper, tag):
    text = "The town council met on Monday and spoke about the new bridge over the river for two hours."
    inner = f"<{tag}>" + f"<p>{text}</p>" * 6 + f"</{tag}>"
    side = "<ul class='nav-links'><li><a href=x>Home page</a><li><a href=y>All news</a></ul><div class='cookie-notice'>We use cookies to improve things a lot.</div>"
    got = mincut.main_text(f"<body><div {wrapper}>{side}{inner}<div class='footer-legal-text'>Terms and prices may change.</div></div></body>")[0]
    assert got == " ".join([text] * 6)


def test_parts_named_as_layout_stay_out():
    text = "The town council met on Monday and spoke about the new bridge over the river for two hours."
    long = "I did enjoy this a lot and would like to read more of it soon, thank you. " * 4
    page = f"<body><article>{f'<p>{text}</p>' * 9}</article><div id='comments'>{f'<article><p>{long}</p></article>' * 3}</div><div class='sidebar'><p>{long}</p></div></body>"
    assert mincut.main_text(page)[0] == " ".join([text] * 9)


def test_extraction_of_given_pages(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert mincut.main_text(r.html)[0] == want


def test_deep_nesting_is_linear():
    assert mincut.main_text("<div>" * 20000 + "<p>One sentence of the text stands here. " * 200)[2] == 200


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:3]:
        kept = pipeline.written(stage(spark, docs, SMALL), "test")
        assert kept.columns == docs.columns and kept.count() <= before, name
        docs, before = kept, kept.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = reference.near_duplicates(rows)
    assert len({d for d, _ in rows}) == len(rows) and all(v[2] == 0 and v[1] == d for d, v in found.items())
    mixed = pipeline.mix(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    encoded = pipeline.run(spark, SMALL)
    assert encoded.count() == mixed.count()


def test_quality_weights_stand_once_in_a_plan(spark, documents, labels, monkeypatch):
    """pipeline: each use of the constant weights took its megabytes of driver memory again, in every printed plan."""
    text = ",".join(["NaN"] * 60 + ["0.123456789"] * 4)
    monkeypatch.setattr(importance, "bin_weights", lambda *a: F.split(F.lit(text), ",").cast("array<double>"))
    for made in (importance.quality_rules, importance.passing_documents):
        plan = made(documents, labels, 64)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("0.123456789") == 4
