import re
from collections import Counter, defaultdict

import pytest

from rillway.llm.mixing import OP6_SQL, mix_sources, op6_mix_sources, select_mixed
from rillway.llm.quality import OP9_SQL, judged, op9_quality_rules
from tests.compare import same_rows
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "One more sentence ends here.\n" * 60_000, 5, 6), (None, None, 7, 8)], "doc_id long, text string, by_word int, kept int")
    rows = {r.doc_id: r for r in judged(docs).collect()}
    assert rows[1].n_words == 300_000 and rows[1].n_repeat_words == 300_000 and rows[1].n_dup_lines == 59_999 and rows[1].by_word == 5 and not rows[None].kept
    names = ["__total", "__takes", "__of", "takes", "copy", "of"]
    mixed = spark.createDataFrame([(k, f"a b c {k}", f"s{k % 3}", *range(6)) for k in range(40)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    out = select_mixed(mixed)
    assert out.columns == mixed.columns and all([r[c] for c in names] == list(range(6)) for r in out.collect())


def test_op9_against_sql(spark, sf_dir, duck):
    same_rows(op9_quality_rules(spark, sf_dir), duck, OP9_SQL)


def base(text):
    words = WORD.findall(text or "")
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_base_figures_against_brute_force(spark):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "x " * 20, "x " * 8, "x " * 9, "# * | <b> & %$\n\n# * | <b> & %$"]
    docs = edge.documents(spark).union(spark.createDataFrame([(100 + k, t, "en", "s", 0, 0, "", "", 0, 100 + k) for k, t in enumerate(texts)], edge.SCHEMA))
    out = judged(docs)
    given = {r.place: r.text for r in docs.collect()}
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(given[r.place]), given[r.place]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert judged(edge.no_documents(spark)).count() == 0


@pytest.mark.parametrize("line, good", [
    ("A plain sentence ends here.", True), ("no end here", False), ("Home | News | Sport | Contact.", False), ("ALL OF THIS IS LOUD.", False), ("All rights reserved.", False), ("Alle Rechte vorbehalten.", False), ("Tous droits réservés.", False), ("Todos los derechos reservados.", False),
    ("Cookie, newsletter: " + "word " * 20 + "ends.", False), ("A cookie " + "word " * 30 + "ends.", True),
    ("### $$$ %%% &&& text.", False), ("Quoted “so”", True), ("Ends well.  ", True),
])
def test_line_rules(spark, line, good):
    text = edge.prose(3, 3).capitalize() + "\n" + line
    assert (line in judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().clean_text) == good


def test_documents_that_lose_most_go(spark):
    good, bad = edge.prose(1, 30), edge.prose(2, 30).rstrip(".")
    docs = spark.createDataFrame([(1, good), (2, bad), (3, good + "\n" + bad[:60])], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in judged(docs).collect()} == {1: True, 2: False, 3: True}


def test_op6_against_sql(spark, sf_dir, duck):
    same_rows(op6_mix_sources(spark, sf_dir), duck, OP6_SQL)


def targets(sizes):
    """By resharing step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    out = {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("shape", [{"a": 50}, {"a": 50, "b": 1}, {"a": 3, "b": 400, None: 60, "Z": 7, "é": 30}, {"a": 1, "b": 1, "c": 1}])
def test_mix_comes_near_its_targets(spark, shape):
    rows = [(k, " ".join(["w"] * (1 + (k * 7) % 13)), s) for k, s in enumerate(s for s, n in shape.items() for _ in range(n))]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 13


def test_mix_of_edge_rows(spark):
    docs = edge.documents(spark)
    out = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    again = mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mix_sources(edge.no_documents(spark)).count() == 0 and select_mixed(edge.no_documents(spark)).count() == 0


def test_selected_rows_are_those_that_are_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = {r.doc_id: r.taken // r.size for r in mix_sources(docs).collect() if r.size}
    rows = select_mixed(docs)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect() if r.doc_id in times) == Counter({k: n for k, n in times.items() if n})
