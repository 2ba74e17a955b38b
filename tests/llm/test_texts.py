import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import html_text, language_id, quality


def test_quality_base(spark):
    r = random.Random(3)
    texts = [None, "", " \n ", "a b a b a b", "x\nx\n\n x\nx", "#a $ b | <c>", "the cat\x0bsat " * 30] + [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 90))) for _ in range(60)] + ["w" + " v" * 40_000]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    for x in quality.judge(df, {}).collect():
        t = texts[x.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        held = {i + k for i, a in enumerate(tri) if c[a] > 1 for k in range(3)}
        lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(held))
        assert x.base_failed == (len(w) < 50 or 100 * len(held) > 50 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality.judge(df.where("false"), {}).count() == 0


def test_quality_verdict(spark):
    r = random.Random(5)
    rare = {k: [f"{a}{b}{c}" for a in starts for b in "aeiou" for c in ("lm", "nd", "rt", "st")] for k, starts in (("en", "bdfgh"), ("fr", "jklmn"))}
    small = {"en": "the of and to in a is that it was".split(), "fr": "de la le et les des en un du une".split()}

    def text(lang, n):
        return " ".join(r.choice(small[lang]) if r.random() < 0.4 else r.choice(rare[lang]) for _ in range(n)) + "."

    rows = [(i, text(lang, r.randrange(60, 400)), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = quality.fit(docs)
    assert sorted(learned) == ["en", "fr"] and set(list(learned["en"].words)[:10]) == set(small["en"]) and learned["en"].words != learned["fr"].words
    gibberish = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200))
    keywords = " | ".join("".join(r.choice("aeioumnrst") for _ in range(6)) for _ in range(200))
    symbols = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text("en", 200).split())
    odd = spark.createDataFrame([(1, gibberish), (2, keywords), (3, symbols), (4, text("en", 200)), (5, text("fr", 60)), (5, text("fr", 60)), (6, "x" * 200_000 + (" " + text("en", 300)) * 1)], "doc_id long, text string")
    found = {x.doc_id: x for x in quality.judge(odd, learned).collect()}
    assert not any(found[i].base_failed for i in (1, 2, 3)) and [found[i].kept for i in range(1, 6)] == [False, False, False, True, True]
    # Either histogram rejects by itself.
    few = quality.QualityParams(max_char_distance=9.0)
    assert [x.kept for x in quality.judge(odd.where("doc_id = 1"), learned, params=few).collect()] == [False]
    few = quality.QualityParams(max_word_distance=9.0)
    assert [x.kept for x in quality.judge(odd.where("doc_id = 3"), learned, params=few).collect()] == [False]
    assert quality.fit(docs.where("false")) == {} and quality.fit(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_quality_learns_from_every_row(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "The even").otherwise("the odd1").alias("text"), F.lit("en").alias("lang"))
    learned = quality.fit(rows.unionByName(rows.withColumn("doc_id", F.lit(None).cast("long"))))["en"]
    assert learned.words == {"the": 0.5, "even": 0.25, "odd1": 0.25} and learned.chars == (0.0625, 0.0, 0.0, 0.125, 0.8125)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>var a='<p>x</p>'</script>", ""),
        ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>One  two<br>three, a sentence that is long enough.</p><p><b>Four<p>Five.</article><div class='ad'>Buy this now. It is good, really.</div><footer>&copy; x</footer></body>", "Title & more\n\nOne two three, a sentence that is long enough.\n\nFour\n\nFive."),
        ("<main><p>Body text of the page, which goes on for a while.</p><aside>Other things to read here, and more.</aside><div id='comments'><p>I disagree with this, as a reader, very much.</p></div><form>Name <input></form></main>", "Body text of the page, which goes on for a while."),
        ("<div class='cookie-notice'><p>We use cookies. Please accept them, thank you.</p></div><div class='content'><ul><li>first point</li><li>second point</li></ul></div>", "first point\n\nsecond point"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<head><title>x</title><p>A page without a body, but with a sentence or two. Here it is.", "A page without a body, but with a sentence or two. Here it is."),
        ("<form action=/><article><p>An article inside a page-wide form, long enough to be read.</p></article></form>", "An article inside a page-wide form, long enough to be read."),
        ("<div class='main-content with-sidebar'><p>Text in a main column beside a sidebar, of some length.</p></div>", "Text in a main column beside a sidebar, of some length."),
        ("<p>Before the unclosed element, a sentence.</p><noscript><p>The rest of the page, which must stay as it is.</p>", "Before the unclosed element, a sentence.\n\nThe rest of the page, which must stay as it is."),
        ("<div>" * 5000 + "<p>Deep text, of some length, stays as it is.</p>" + "</div>" * 5000, "Deep text, of some length, stays as it is."),
        ("<div>" * 5000 + "<p>Deep text that is never closed, of some length, stays as it is.", "Deep text that is never closed, of some length, stays as it is."),
    ],
)
def test_no_text_is_lost(html, text):
    assert html_text.main_text(html) == text


def test_very_long_page():
    part = "<p>One more sentence of the article, of some length, for page %d of it.</p>"
    assert html_text.main_text("<nav><a href=/>Home</a></nav><main>" + "".join(part % i for i in range(20_000)) + "</main>").count("\n\n") == 19_999


def test_the_cut_decides():
    """A short entry amid the paragraphs of an unmarked page is content by its neighbours, a sentence amid links is not."""
    p = "<p>A long paragraph of running text, with commas, stops and all that; it goes on for quite a while, as such paragraphs do. It has more than one sentence.</p>"
    link = "<li><a href=/x>Somewhere else</a></li>"
    html = f"<div><ul>{link * 4}<li>Read this now, it is new. Or that.</li>{link * 4}</ul></div><div>{p * 2}<div>And short</div>{p * 2}</div>"
    blocks = html_text.read(html)
    alone = [html_text.score(b) > 0 for b in blocks]
    found = html_text.labels(blocks)
    assert alone != found
    assert [b.text for b, k in zip(blocks, found) if k] == [blocks[-1].text] * 2 + ["And short"] + [blocks[-1].text] * 2


def test_fit():
    pages = [f"<nav><ul><li><a href=/>Part {i}</a></li></ul></nav><article><h1>On {i}</h1><p>The text of page {i}, which is of some length. It has stops.</p></article>" for i in range(30)]
    weights = html_text.fit_weights(pages)
    assert html_text.fit_weights([]) == html_text.fit_weights(["<p>no mark here</p>"]) == html_text.BY_HAND
    at = dict(zip(html_text.FEATURES, weights))
    assert at["links"] < 0 < at["paragraph"]
    assert all(html_text.main_text(x, weights).startswith("On ") and "Part" not in html_text.main_text(x, weights) for x in pages)


def test_cut_is_minimal():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 8)
        scores = [r.choice([-3, -2, -1, 1, 2, 3]) * 1.0 + r.random() for _ in range(n)]
        edges = [(a, b, r.random() * 3) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]

        def cost(side):
            return sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(scores, edges)) == pytest.approx(best)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", "<p>Hello there, this is a text of some length.</p>", "old")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "Hello there, this is a text of some length."]
    assert html_text.extract(df.where("false")).count() == 0


def path_score(scores, path, penalty):
    return sum(scores[i][k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_and_its_shortcut():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(150):
        n, k = int(r.integers(1, 6)), int(r.integers(1, 4))
        s = r.normal(size=(n, k)) * 3
        best = max(path_score(s, p, 2.0) for p in itertools.product(range(k), repeat=n))
        assert path_score(s, language_id.viterbi(s[None], 2.0)[0], 2.0) == pytest.approx(best)
        one = language_id.constant(s, 2.0)
        if one >= 0:
            assert path_score(s, [one] * n, 2.0) == pytest.approx(best)


def test_languages(spark):
    en, de, ru = "the people of the town were with the others and that was all ", "die Leute aus der Stadt waren mit den anderen und das war schon alles ", "люди из города были вместе с другими и это было всё "
    rows = [(i, (en, de, ru)[i % 3] * (1 + i % 4), ("en", "de", "ru")[i % 3]) for i in range(60)] + [(60, None, "en"), (61, "123 !", "en"), (62, en, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1))
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = {r.doc_id: r.language for r in language_id.identify(docs, model).collect()}
    assert all(found[i].lang == ("en", "de", "ru")[i % 3] and found[i].score > 0.9 for i in range(60))
    assert [found[i].lang for i in (60, 61, 62)] == ["und", "und", "en"] and found[60].score == 0
    mixed = spark.createDataFrame([(1, en * 3 + de * 3)], "doc_id long, text string")
    spans = language_id.identify(mixed, model).first().language.spans
    assert [s.lang for s in spans] == ["en", "de"] and spans[0].first == 0 and spans[1].last == len((en * 3 + de * 3).split()) - 1
    # A script that no learned language uses says nothing; ties go to the first language.
    odd = spark.createDataFrame([(1, "שלום עולם"), (2, "สวัสดีชาวโลก"), (3, en + "שלום עולם"), (4, en), (4, en), (5, en * 30_000)], "doc_id long, text string")
    of = {r.doc_id: r.language for r in language_id.identify(odd, model).collect()}
    assert [(of[i].lang, of[i].score) for i in (1, 2)] == [("de", 0.0)] * 2
    assert of[3].lang == of[4].lang == of[5].lang == "en" and 0.7 < of[3].score < 0.95 and of[5].score == 1.0
    none = language_id.fit(docs.where("false"))
    assert {r.language.lang for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0
