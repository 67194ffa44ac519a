from collections import Counter

import corpus_pipeline
from rillway.llm.staging import stage
from rillway.llm.language import Languages, fold, learn, usual_phrases
from rillway.llm.mixing import mix_sources
from tests.llm import edge
from tests.llm.test_dedup import brute_classes, brute_lines, classes_of
from tests.llm.test_tokens import check_packed


def key(r, columns=("doc_id", "text")):
    return tuple(r[c] for c in columns)


def check_stages(spark, docs, sf_dir):
    """Holds each stage's output against brute force over its own input."""
    from pyspark.sql import functions as F

    given = docs
    for name, step in corpus_pipeline.STAGES:
        before = given.collect()
        out = stage(step(spark, given, sf_dir), name)
        after = out.collect()
        if name == "language_id":
            samples = learn(given.where(fold(F.col("doc_id")) != 2))
            languages, usual = Languages(samples), usual_phrases(samples)
            verdict = [languages.judge([r.text])[0] for r in before]
            least = lambda lang, n: min(corpus_pipeline.LEAST_PHRASE, corpus_pipeline.LEAST_SHARE * usual.get(lang, 99)) * (1 - 0.5 * n**-0.5)
            want = Counter(key(r) for r, (lang, _, mean, n) in zip(before, verdict) if lang != "und" and mean >= least(lang, n))
            assert Counter(map(key, after)) == want
        elif name == "near_duplicates":
            assert {r.doc_id for r in after} == {c for _, c, _ in brute_classes(before)} and len(after) == classes_of(before)
        elif name == "line_dedup":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            rank = lambda r: (r.doc_id is None, r.doc_id or 0, r.place if "place" in r else 0)
            left = [x for x, _ in brute_lines([r.text for r in sorted(before, key=rank)])]
            assert Counter(r.text for r in after) == Counter(left) and all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "mix_sources":
            times = Counter()
            for r in mix_sources(given).collect():
                if r.size:
                    times[r.doc_id] += r.taken // r.size
            assert Counter(r.doc_id for r in after if (r.text or "").split()) == +times
        else:
            check_packed(after, before)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        given = out
    return given


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = check_stages(spark, docs, sf_dir)
    pieces = ("doc_id", "piece", "length", "ids_crc32")
    assert Counter(key(r, pieces) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(key(r, pieces) for r in last.collect())


def test_edge_rows_pass_through(spark, sf_dir):
    check_stages(spark, edge.documents(spark), sf_dir)


def test_foreign_texts_go_and_short_ones_stay(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    more = [(10**6, "Это русский текст о погоде и природе, который довольно длинный и понятный."), (10**6 + 1, "qzx wvkj pqrz xxkj vbnm qwrt zxcv plkj hgfd jklm wqqz xkcd vvbw zzpq"), (10**6 + 2, "Re."), (10**6 + 3, "12 34")]
    docs = known.union(spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, lang string"))
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf_dir).collect()}
    assert {r.doc_id for r in known.collect()} | {10**6 + 2} == left


def test_empty_table(spark, sf_dir):
    docs = edge.no_documents(spark)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_the_entry_works_without_this_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{top}/rillway", tmp_path / "rillway", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'session_aggr_stat' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
