import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.llm import topk
from rillway.llm.language import STRETCH, Languages, fold, identify, learn, op10_language_id, suffix_automaton
from rillway.llm.pages import extract, main_text, minimum_cut, op5_html_extraction
from rillway.llm.topk import OP7_SQL, integer_vectors, op7_maxscore_top_k, search_shard, top_k
from tests.compare import same_rows
from tests.llm import edge


def test_op7_against_sql(spark, sf_dir, duck):
    same_rows(op7_maxscore_top_k(spark, sf_dir), duck, OP7_SQL)


@pytest.mark.parametrize("largest", [2, 60, 10**5, 10**12])
def test_shard_search_against_all_scores(largest):
    rng = np.random.default_rng(largest % 97)
    for n, m, d in ((0, 3, 2), (5, 4, 3), (2500, 6, 9)):
        v, q = rng.integers(-largest, largest + 1, (n, d)), rng.integers(-largest, largest + 1, (m, d))
        ids, own = rng.integers(0, max(n, 1), n), rng.integers(0, n + 1, m)
        scores = q.astype(object) @ v.astype(object).T
        clipped = lambda x: min(max(int(x), -(2**63)), 2**63 - 1)  # noqa: E731  scores are longs
        want = [sorted((-clipped(scores[i, j]), int(ids[j])) for j in range(n) if ids[j] != own[i])[:20] for i in range(m)]
        assert [[(-int(s), int(x)) for x, s in zip(a, b)] for _, a, b in search_shard(q, own, v, ids, 20)] == want


@pytest.mark.parametrize("shard, block, cells", [(300, 7, 1 << 22), (1 << 20, 1 << 20, 64)])
def test_many_shards_against_one(spark, monkeypatch, shard, block, cells):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "CELLS", cells)
    rng = np.random.default_rng(3)
    vecs = [rng.integers(-9, 10, int(n)).tolist() for n in rng.integers(0, 40, 900)] + [[5, 5, 5]] * 60
    vectors = spark.createDataFrame([(k, x) for k, x in enumerate(vecs)], "vec_id long, terms array<long>")
    queries = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_row", "vec_id AS query_id", "terms")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(vectors, queries).collect()}
    for i in range(0, len(vecs), 50):
        scores = sorted((-sum(a * b for a, b in zip(vecs[i], x)), k) for k, x in enumerate(vecs) if k != i)[:20]
        assert [got[i, n + 1] for n in range(20)] == [(k, -s) for s, k in scores]


def test_scores_beyond_64_bits_and_a_wide_vector(spark):
    rows = [(0, [1e10, 1e10]), (1, [1e10, 1e10]), (2, [1e30, 1.0]), (3, [-1e30, 1.0]), (20, [1e10] * 3), (4, [1.0] * 300_000)]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS query_row", "vec_id AS query_id", "terms")
    found = [(r.vec_id, r.score) for r in top_k(vectors, queries).where("query_id = 0").orderBy("rank").collect()]
    most = 2**63 - 1
    assert found == [(1, most), (2, most), (20, most), (4, 2 * 64 * 64 * 10**10), (3, -(2**63))]


def test_search_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, [0.26, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (1, [0.26, 0.5])]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(r.vec_id for r in vectors.collect()) == [0, 1, 1, 6, 7]
    queries = vectors.where("vec_id = 0").select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "terms")
    assert [(r["rank"], r.vec_id, r.score) for r in top_k(vectors, queries).orderBy("rank").collect()] == [(1, 6, 4096), (2, 1, 0), (3, 1, 0), (4, 7, 0)]
    assert top_k(vectors.limit(0), queries).count() == 0 and top_k(vectors, queries.limit(0)).count() == 0


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        value = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda l: sum(max(0, v) if not x else max(0, -v) for v, x in zip(value, l)) + sum(c for a, b, c in edges if l[a] != l[b])  # noqa: E731, B023
        best = min(map(cost, itertools.product((False, True), repeat=n)))
        assert cost(minimum_cut(value, edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>x</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href="/b">News &amp; more</a></ul></nav>
<div id="content"><h1>Title&nbsp;here</h1><p>A first paragraph that has enough words to count as running text,
  with <b>bold</b> &lt;signs&gt; and&#32;more.<p>Short.</p><div class="ad-slot">Buy this cheap thing today, dear reader, it is on sale only now.</div>
<p>Another paragraph that has enough words to count as running text, even though it says little.</p></div>
<aside><p>Other things that you may want to read some day when you have time for that.</p></aside>
<section id="comments"><p>I liked reading this very much and will come back for more of it soon.</p></section>
<form><p>Leave your name and address here so that we can write to you about our products.</p></form><!-- end -->
<footer>&copy; all of it</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "Title here", "A first paragraph that has enough words to count as running text, with bold <signs> and more.", "Short.",
        "Another paragraph that has enough words to count as running text, even though it says little.",
    ]
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>only code") == ""
    long = "<article>" + "<p>" + "many words in a long text. " * 40000 + "</article>"
    assert len(main_text(long)) == 27 * 40000 - 1
    assert main_text("<article><p>" * 3000 + "deep text that goes on for quite some words in a row here.") == "deep text that goes on for quite some words in a row here."


@pytest.mark.parametrize("page", [
    '<a "' * 250_000, "<b>" * 10_000 + "</i>" * 10_000, '<p title="x>y' * 70_000, "<ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<b>" * 20_000 + "<div></div>x" * 20_000,
    "<article>" + "<i>" * 20_000 + "</b>" * 20_000, "<" * 1_000_000, "<!--" * 200_000, "<a x" + " " * 500_000 + "y",
])
def test_broken_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4


FIRST, SECOND = "The share price of the firm rose by ten percent on Monday, after the news came out.", "A second paragraph follows it here, quite as long as the first one was, and then it ends."


@pytest.mark.parametrize("page", [
    f'<article><div class="story-share-price"><p>{FIRST}</p></div><p>{SECOND}</p><div class="share-buttons"><a href=x>Tweet</a> <a href=y>Mail</a></div></article>',
    f'<article><p title="x>{FIRST}</p><p class="y">{SECOND}</p></article>',
    f'<article><p data-x="<b>bold</b>">{FIRST}</p><p>{SECOND}</p><section class="comments"><p>I liked this article a lot, it was really worth reading to the end.</p></section></article>',
    f'<body><table><tr><td><ul class="menu"><li><a href=/>Start</a><li><a href=/x>More</a></ul><td><div id="main"><p>{FIRST}<p>{SECOND}</div></table><div id=footer>All rights reserved by the firm that runs this page for you.</div>',
    f'<main><h2 hidden>no</h2><p>{FIRST}</p><p>{SECOND}</p></main><div role="complementary"><p>Other things that you may want to read some day when you have time for that.</p></div>',
    f'<div class="cookie-banner"><p>We use cookies to make this page better for you and for all of our partners.</p></div><div class="inhalt"><p>{FIRST}</p><p>{SECOND}</p></div><div class="kommentare"><p>Das hat mir sehr gut gefallen, und ich komme sicher bald wieder hierher.</p></div>',
    f"<header><p>A long line about the site that has nothing to do with the article itself, at all.</p></header><article><header><p>{FIRST}</p></header><p>{SECOND}</p></article>",
])
def test_other_templates(page):
    assert main_text(page) == f"{FIRST}\n{SECOND}"


def test_pages_keep_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text == main_text(PAGE), r.n_chars) for r in out.collect()) == Counter({(1, True, len(main_text(PAGE))): 2, (None, False, 0): 1})
    assert extract(pages.limit(0)).count() == 0


def test_op5_gives_the_article(spark, sf_dir):
    import html
    import re

    rows = {r.page_id: r.text for r in op5_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
        assert rows[r.page_id] == "\n".join(filter(None, parts))


def test_suffix_automaton_knows_all_substrings():
    text = [1, 2, 1, 1, 2, 2, 1, 2]
    t = suffix_automaton(text, 3)
    inside = {tuple(text[a:b]) for a in range(8) for b in range(a, 9)}
    for n in range(1, 5):
        for s in itertools.product((1, 2), repeat=n):
            state = 0
            for c in s:
                state = t[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in inside)


def phrases(symbols, texts):
    """How many phrases a list of symbols needs of texts (lists of symbols), by looking for each phrase."""
    known = "".join("".join(map(chr, t)) + "\0" for t in texts)
    count = 0
    s, i = "".join(map(chr, symbols)), 0
    while i < len(s):
        count += 1
        if s[i] == "\0" or s[i] not in known:
            i += 1  # an unknown symbol begins a phrase that goes on with what follows
        n = 0
        while i + n < len(s) and s[i + n] != "\0" and s[i : i + n + 1] in known:
            n += 1
        i += n
    return count


def test_long_texts_are_parsed_as_a_whole():
    rng = random.Random(6)
    samples = [("a", ["the cat sat on the mat. he he he he he and so on"]), ("b", ["le chat est là où il est"])]
    languages = Languages(samples)
    texts = [" ".join(rng.choices("the cat sat on mat le chat est zq a".split(), k=5000)), "he " * 3000, "x" * 5000, "the mat on a bat " * 900, "t" * (2 * STRETCH), "ЖЯ" * 1500]
    found = languages.phrases(texts)
    for k, text in enumerate(texts):
        symbols = languages.coded([text])[0].tolist()
        for j, (_, known) in enumerate(samples):
            assert found[j, k] == phrases(symbols, [languages.coded([t])[0].tolist() for t in known]), (k, j)


def test_parse_against_search():
    samples = [("a", ["the cat sat on the mat.", "a hat; a bat"]), ("b", ["le chat est là où il est", "ça va bien?"])]
    languages = Languages(samples)
    texts = ["the hat sat", "le chat", "où est the cat", "zzz qq", "x", "1 2 3", "the mat on a bat " * 200, ""]
    found = languages.phrases(texts)
    for k, text in enumerate(texts):
        symbols = languages.coded([text])[0].tolist()
        for j, (_, known) in enumerate(samples):
            assert found[j, k] == phrases(symbols, [languages.coded([t])[0].tolist() for t in known]), (text, j)
    together = languages.phrases(texts * 700)  # more stretches than are walked at a time
    assert (together == np.tile(found, 700)).all()


def test_languages_of_edge_rows(spark):
    docs = edge.documents(spark).withColumn("lang_pred", F.lit("old"))
    samples = learn(docs.where(fold(F.col("doc_id")) != 2))
    assert {name for name, _ in samples} <= {"en", "fr"}
    out = identify(docs, samples).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert identify(edge.no_documents(spark), samples).count() == 0 and learn(edge.no_documents(spark)) == []
    assert {r.lang_pred for r in identify(docs, []).collect()} == {"und"}


def test_op10_on_held_out_rows(spark, sf_dir):
    rows = op10_language_id(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [(r.lang_pred, docs[r.doc_id].lang) for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)


def many_letters(n, size, seed, first=0x4E00):
    """Texts of an alphabet of 1,500 letters, the frequent ones first."""
    rng = random.Random(seed)
    return ["".join(chr(first + x) for x in rng.choices(range(1500), [1 / (k + 1) for k in range(1500)], k=size)) for _ in range(n)]


def test_parse_with_more_letters_than_columns():
    from rillway.llm.language import ALPHABET

    samples = [("a", ["the cat sat on the mat."]), ("zh", many_letters(20, 300, 1))]
    languages = Languages(samples)
    assert languages.symbols > 5 * ALPHABET
    texts = [*many_letters(4, 200, 2), samples[1][1][3], "the cat " + samples[1][1][5][7:90] + " mat", "ЖЯ the"]
    found = languages.phrases(texts)
    for k, text in enumerate(texts):
        symbols = languages.coded([text])[0].tolist()
        for j, (_, known) in enumerate(samples):
            assert found[j, k] == phrases(symbols, [languages.coded([t])[0].tolist() for t in known])


def test_documents_of_a_learned_language_of_many_letters_stay(spark, sf_dir):
    import corpus_pipeline

    latin = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    clean = [(10**6 + k, t, "zh") for k, t in enumerate(many_letters(80, 600, 3))]
    foreign = [(10**7 + k, t, None) for k, t in enumerate(many_letters(5, 600, 4, 0xAC00))]
    docs = spark.createDataFrame(latin + clean + foreign, "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf_dir).collect()}
    assert {r[0] for r in clean} <= left and not {r[0] for r in foreign} & left


def test_languages_of_long_texts_are_learned(spark):
    from rillway.llm.language import SAMPLE_TEXT

    long = "1 2 3 " * 2000 + "der hund und die katze im haus " * 400
    rows = [(k, "the cat and the dog in the house", "en") for k in range(5)] + [(10 + k, long + "x" * k, "de") for k in range(3)] + [(7, " ", "blank"), (8, "12", "digits")]
    rows += [(99, f"le chat et le chien {k}", "fr") for k in range(3000)]  # one id: no place, or all
    samples = dict(learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert sorted(samples) == ["de", "en", "fr"]
    assert all(len(x) == SAMPLE_TEXT and x.startswith("der hund") for x in samples["de"]) and samples["fr"]
    docs = spark.createDataFrame([(1, "die katze und der hund")], "doc_id long, text string")
    assert identify(docs, list(samples.items())).first().lang_pred == "de"


def test_of_too_many_labels_those_of_most_rows_are_learned(spark, monkeypatch):
    from rillway.llm import language

    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = [(k, f"some text of {name} number {k}", name) for name, n in (("en", 9), ("fr", 5), ("b", 2), ("a", 2), ("dirty", 1)) for k in range(n)]
    samples = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [name for name, _ in samples] == ["a", "en", "fr"]
    assert sum(len(t) for _, texts in samples for t in texts) <= language.ALL_CHARS
