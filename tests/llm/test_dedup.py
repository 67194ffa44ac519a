import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.llm import near
from rillway.llm.components import components
from rillway.llm.lines import MIN_RUN, MIN_UNIT, OP2_SQL, Units, cut, op2_line_dedup, remove_repeated_lines
from rillway.llm.near import first_of_each_class, near_duplicates, op4_jaccard_join
from rillway.llm.suffixes import op8_suffix_dedup, remove_repeats, repeated_starts
from tests.compare import same_rows
from tests.llm import edge


def shingles(text):
    words = (text or "").lower().encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes_of(docs):
    """How many classes there are: rows of one id can be in several."""
    return brute_classes(docs, True)


def brute_classes(docs, number=False):
    """(doc_id, class_id, n_links) of every row, by comparing all pairs."""
    sets = [shingles(r.text) for r in docs]
    key = [(r.doc_id is None, r.doc_id or 0) for r in docs]
    root = list(range(len(docs)))
    links = Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by_shingle[x] if j > i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    if number:
        return len({top(k) for k in range(len(docs))})
    smallest = {}
    for k in range(len(docs)):
        smallest[top(k)] = min(smallest.get(top(k), (True, 0)), key[k])
    return Counter((r.doc_id, None if smallest[top(k)][0] else smallest[top(k)][1], links[k]) for k, r in enumerate(docs))


def found_classes(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_near_duplicates_against_all_pairs(spark):
    docs = edge.documents(spark)
    assert found_classes(near_duplicates(docs)) == brute_classes(docs.collect())
    assert near_duplicates(edge.no_documents(spark)).count() == 0


def test_op4_against_all_pairs(spark, sf_dir):
    assert found_classes(op4_jaccard_join(spark, sf_dir)) == brute_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_large_group_of_borderline_copies_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 5), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(near_duplicates(docs)) == brute_classes(docs.collect())


def template(n, shared, words=100):
    return [(k, " ".join([f"t{i}" for i in range(shared)] + [f"x{k}y{i}" for i in range(words - shared)])) for k in range(n)]


@pytest.mark.parametrize("torn", [4, 512])
def test_split_buckets_lose_no_link(spark, monkeypatch, torn):
    monkeypatch.setattr(near, "TORN", torn)
    rng = np.random.default_rng(8)
    rows = template(150, 62)
    for k in range(60):  # pairs about the threshold among texts of one template
        words = rows[k][1].split()
        for at in rng.choice(np.arange(62, 100), int(rng.integers(1, 6)), replace=False):
            words[at] = f"z{k}"
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(near_duplicates(docs)) == brute_classes(docs.collect())


@pytest.mark.parametrize("shared", [42, 62])
def test_texts_of_a_template_are_not_candidates(spark, monkeypatch, shared):
    """What goes from one step to the next grows with the rows, though all texts share a part."""
    rows_of = Counter()
    kept = near.stage

    def counted(df, label):
        out = kept(df, label)
        if label in ("tied", "across", "groups", "found"):
            rows_of[label] += out.count()
        return out

    monkeypatch.setattr(near, "stage", counted)
    docs = spark.createDataFrame(template(1500, shared), "doc_id long, text string")
    assert {r.n_links for r in near_duplicates(docs).collect()} == {0} and sum(rows_of.values()) == 0


def test_bayes_thresholds():
    least = near.least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(least, least[1:])) and 0 < least[0] < 0.8 * near.STEP
    # a pair at the similarity survives all steps but with a tiny probability
    agree = np.random.default_rng(1).random((4000, near.HASHES)) < 0.8
    assert near.plausible(agree.astype(np.uint16), np.ones_like(agree, np.uint16), 0.8, 1e-6).all()
    far = np.random.default_rng(1).random((4000, near.HASHES)) < 0.4
    assert not near.plausible(far.astype(np.uint16), np.ones_like(far, np.uint16), 0.8, 1e-6).any()


def test_one_of_each_class_stays_with_its_columns(spark):
    docs = edge.documents(spark)
    kept = first_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    classes = {(r.class_id is None, r.class_id or 0) for r in near_duplicates(docs).collect()}
    assert ids == sorted([*classes, (False, 11)])  # two texts of id 11, each the first of a class
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in first_of_each_class(unique).collect()) == sorted({r.class_id for r in near_duplicates(unique).collect()})


@pytest.mark.parametrize("links, expected", [
    ([], {}), ([(1, 2), (2, 3), (9, 8), (5, 5)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(k, k + 1) for k in range(40)], {k: 0 for k in range(41)}), ([(0, k) for k in range(1, 30)], {k: 0 for k in range(30)}),
])
def test_components(spark, links, expected):
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(expected) and {r.id: r.component for r in found} == expected


def test_line_dedup_against_sql(spark, sf_dir, duck):
    same_rows(op2_line_dedup(spark, sf_dir), duck, OP2_SQL)


def brute_lines(rows):
    """Text and spans of each row (rows in the order of their ranks), by comparing the units' words."""
    seen, out = set(), []
    for text in rows:
        if text is None:
            out.append((None, []))
            continue
        u = Units(text, MIN_UNIT)
        again = []
        for k, (x, y) in enumerate(zip(u.first.tolist(), u.last.tolist())):
            unit = " ".join(text[u.start[t] : u.end[t]].lower() for t in range(u.at[x], u.at[y]))
            if unit in seen:
                again.append(k)
            seen.add(unit)
        left, gone = cut(text, u.spans(np.array(again, np.int64), MIN_RUN)) if again else (text, [])
        out.append((left, [(x["begin"], x["end"]) for x in gone]))
    return out


def test_line_dedup(spark):
    docs = edge.documents(spark)
    out = remove_repeated_lines(docs, spans_col="gone")
    assert out.columns == [*docs.columns, "gone"] and out.count() == docs.count()
    assert remove_repeated_lines(docs, spans_col="spans").columns == [*[c for c in docs.columns if c != "spans"], "spans"]
    rank = lambda r: (r.doc_id is None, r.doc_id or 0, r.place)  # noqa: E731  rows of one id are numbered as they come
    before = sorted(docs.collect(), key=rank)
    after = sorted(out.collect(), key=rank)
    assert [(r.text, [(g.begin, g.end) for g in r.gone]) for r in after] == brute_lines([r.text for r in before])
    by = {(r.doc_id, r.place): r.text for r in after}
    assert by[(0, 0)] == edge.prose(0) and by[(5, 5)] == "" and by[(None, 12)] == "" and by[(6, 6)] == "more"
    assert by[(8, 8)] == "\n".join([edge.prose(8, 30), edge.prose(9, 30), ""]) and by[(14, 18)] == edge.prose(14, 30)
    assert remove_repeated_lines(edge.no_documents(spark)).count() == 0


def test_passages_inside_lines_go_and_short_lines_stay(spark):
    passage = "Erand shonti edble onanre lyther ouwhst inge. Hath tionre erly ened thora the and, of thing was. " * 2 + "Short end."
    rows = [(1, "All rights reserved.\nfirst words " + passage + " then other words."), (2, "All rights reserved.\nsecond words " + passage + " and more of them"), (3, passage.upper().replace(" ", "  ") + "\nlast")]
    left = {r.doc_id: r.text for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = "Erand shonti edble onanre lyther ouwhst inge. Hath tionre erly ened thora the and, of thing was. "
    assert left[1] in (rows[0][1], rows[0][1].replace(again * 2, again)) and left[2] == "All rights reserved.\nsecond words and more of them" and left[3] == "last"


def test_unspaced_scripts_have_units_too(spark):
    text = "".join(chr(0x4E00 + (k * k * 7 + k) % 2000) + ("。" if k % 20 == 19 else "") for k in range(400))
    rows = [(1, text), (2, "前" + text[:60] + "。" + text[21:]), (3, "漢字" * 200), (4, "漢字" * 200)]
    left = {r.doc_id: r.text for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == text and len(left[2]) < 100 and left[3] == rows[2][1] and left[4] == ""


def test_rows_without_ids_are_documents_of_their_own(spark):
    texts = [edge.prose(k, 40) for k in range(30)] + [edge.prose(3, 40)] * 3
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    assert Counter(r.text for r in remove_repeated_lines(docs).collect()) == Counter([*{t: 1 for t in texts}, *[""] * (len(texts) - len(set(texts)))])


def test_a_text_of_megabytes(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"{w}." if k % 11 == 10 else w for k, w in enumerate(rng.choice([a + b for a in edge.WORDS for b in edge.WORDS], 400_000).tolist()))
    rows = [(1, long), (2, "before it " + long[1_000_000:1_400_000]), (3, "x" * 3_000_000)]
    left = {r.doc_id: r.text for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == long and left[3] == rows[2][1] and len(left[2]) < 200


def brute_removal(rows, threshold):
    data = [(r.text or "").encode() for r in rows]
    seen = Counter(hash(b[p : p + threshold]) for b in data for p in range(len(b) - threshold + 1))
    out = Counter()
    for r, b in zip(rows, data):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - threshold + 1):
            if seen[hash(b[p : p + threshold])] > 1:
                gone[p] += 1
                gone[p + threshold] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[(r.doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def removed(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("threshold, first, part, together", [(200, 64, 1 << 20, 2000), (40, 16, 1 << 20, 2), (40, 40, 100, 2000), (40, 16, 97, 3), (7, 3, 50, 2000)])
def test_repeats_against_brute_force(spark, threshold, first, part, together):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé"), 300)) for _ in range(12)]
    texts += [texts[0], texts[1][:150] + texts[2][100:], "x" * 500, "xy" * 130, texts[3] + "z" + texts[3], texts[4][30:200] + "q", texts[5][:39], texts[5][:40]]
    docs = edge.documents(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    docs = spark.createDataFrame(docs.collect(), "doc_id long, text string")
    assert removed(remove_repeats(docs, threshold, first, part=part, together=together)) == brute_removal(docs.collect(), threshold)


def test_repeats_give_bytes_and_spans(spark):
    docs = edge.documents(spark)
    for r in remove_repeats(docs, with_bytes=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed
    assert remove_repeats(edge.no_documents(spark)).count() == 0


def test_op8_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    assert removed(op8_suffix_dedup(spark, sf_dir)) == brute_removal(docs.collect(), 200)


@pytest.mark.parametrize("threshold", [5, 8, 40, 200])
def test_thinned_positions_against_plain_doubling(spark, sf_dir, threshold):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 24").select("doc_id", "text")
    covered = defaultdict(set)
    for r in repeated_starts(docs, threshold).collect():
        covered[r.doc].update(range(r.at, r.at + threshold))
    out = remove_repeats(docs, threshold, min(4, threshold), with_bytes=True).collect()
    assert {r.doc_id: {k for s in r.spans for k in range(s.begin, s.end)} for r in out if r.n_spans} == covered


def test_texts_of_null_and_shared_ids_stay(spark):
    a, b, c, d = (edge.prose(k) for k in (20, 31, 42, 53))
    rows = [(None, a), (None, b), (None, b), (None, c), (None, c + " more"), (1, d), (2, d), (2, edge.prose(64)), (None, None), (None, " ")]
    left = first_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter(r.text for r in left)
    assert texts.pop(c, 0) + texts.pop(c + " more", 0) == 1
    assert texts == Counter([a, b, d, edge.prose(64), None, " "])
    assert {r.doc_id for r in left if r.text == d} == {1}
