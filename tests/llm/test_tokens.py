import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillway.llm.staging import new_path
from rillway.llm.staging import settings as session_settings
from rillway.llm import token_files
from rillway.llm.encoding import Encoder, in_groups
from rillway.llm.packing import best_fit, op1_best_fit_packing, pack, pack_documents, pack_pieces
from rillway.llm.token_files import op3_token_files, read_token_files, write_token_files
from tests.llm import edge

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
_LIBRARY = {}


def library(path, text):
    if path not in _LIBRARY:
        _LIBRARY[path] = (Tokenizer.from_file(path), Encoder(path, path == BYTES))
        _LIBRARY[path][0].encode_special_tokens = True
    return _LIBRARY[path][0].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab Zé.,!?'\n\t_0 　\x00-s"), max_size=14))
def test_pieces_give_the_library_ids(path, text):
    want = library(path, text)
    assert _LIBRARY[path][1].encode([text])[0].tolist() == want


def test_groups_cover_all_texts_once():
    texts = ["a" * n for n in (5, 0, 50, 3, 3)] + [None]
    assert [k for a, b in in_groups(texts, 8) for k in range(a, b)] == list(range(6))


def check_files(rows, docs):
    found = sorted((tuple(r) for r in rows), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r.doc_id for r in docs), key=lambda x: (x is None, x))
    assert [r[1] for r in found] == [sum(r[2] for r in found[:k]) for k in range(len(found))]
    want = Counter((r.doc_id, len(ids := [*library(BYTES, r.text), 2]), crc(ids)) for r in docs)
    assert Counter((r[0], r[2], r[3]) for r in found) == want


def test_token_files(spark):
    docs = edge.documents(spark)
    path = new_path(spark, "files")
    shards = write_token_files(docs, path, BYTES, 2)
    rows = read_token_files(spark, path, shards, with_ids=True).collect()
    check_files([r[:4] for r in rows], docs.collect())
    assert all(r.ids[-1] == 2 and crc(r.ids) == r.ids_crc32 for r in rows)
    empty = new_path(spark, "files")
    assert read_token_files(spark, empty, write_token_files(edge.no_documents(spark), empty, BYTES, 2)).count() == 0


def test_rows_without_ids_are_in_several_shards(spark):
    docs = spark.createDataFrame([(None, f"text {k % 50}") for k in range(2000)], "doc_id long, text string").repartition(4)
    path = new_path(spark, "files")
    with session_settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        shards = write_token_files(docs, path, BYTES, 2)
    assert shards.count() > 1
    check_files(read_token_files(spark, path, shards).collect(), docs.collect())


def test_long_texts_and_ranged_reads(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_IDS", 1000)
    docs = spark.createDataFrame([(k, "the cat and " * n) for k, n in enumerate((1, 200_000, 0, 300, 400, 5))], "doc_id long, text string")
    path = new_path(spark, "files")
    shards = write_token_files(docs, path, BYTES, 2)
    check_files(read_token_files(spark, path, shards).collect(), docs.collect())
    store, base = token_files.file_system(path)
    name = f"{base}/{sorted(shards.collect())[0]['name']}.bin"
    mapped, read = token_files._Flat(store, name, "<u2"), token_files._Flat(store, name, "<u2")
    read.map, read.file = None, store.open_input_file(name)
    assert np.array_equal(mapped.part(1, 3), read.part(1, 3)) and mapped.size == read.size


def test_op3(spark, sf_dir):
    check_files(op3_token_files(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def check_packed(rows, docs, capacity=4096):
    want = Counter()
    for r in docs:
        ids = [*library(WORDS, r.text), 1]
        want.update((r.doc_id, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= capacity
    return len(bins)


def test_packing(spark):
    docs = edge.documents(spark)
    check_packed(pack_documents(docs, WORDS, 1, 64).collect(), docs.collect(), 64)
    assert pack_documents(edge.no_documents(spark), WORDS, 1, 64).count() == 0


def test_op1_comes_close_to_the_bound(spark, sf_dir):
    rows = op1_best_fit_packing(spark, sf_dir).collect()
    used = check_packed(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def fewest(sizes, capacity):
    """By trying everything."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(sizes=st.lists(st.integers(0, 20), min_size=0, max_size=9))
def test_search_finds_nearly_the_fewest(sizes):
    where, offset = pack(np.array(sizes, int), 20)
    for k in set(where.tolist()):
        held = sorted((offset[i], sizes[i]) for i in np.flatnonzero(where == k))
        assert sum(n for _, n in held) <= 20
    assert len(set(where.tolist())) <= fewest(sorted(sizes, reverse=True), 20) + 1


def test_swaps_beat_best_fit():
    size = np.random.default_rng(0).integers(800, 2000, 2000)
    where, offset = pack(size, 4096)
    assert np.bincount(where, size).max() <= 4096 and len(set(where.tolist())) < len(best_fit(size, 4096)[1])
    for k in set(where.tolist()):
        held = np.flatnonzero(where == k)
        assert sorted(offset[held]) == [size[held][offset[held] < x].sum() for x in sorted(offset[held])]


@pytest.mark.parametrize("low, high, bound", [(300, 1200, 0.0), (800, 2000, 0.04)])
def test_search_comes_near_the_bound(low, high, bound):
    size = np.random.default_rng(1).integers(low, high, 6000)
    where, _ = pack(size, 4096)
    least = -(-int(size.sum()) // 4096)
    assert least <= len(np.unique(where)) <= least * (1 + bound) + 1
    assert (pack(size, 4096)[0] == where).all()


def test_unlimited_search_leaves_no_exchange():
    size = np.random.default_rng(4).integers(800, 2000, 120)
    where, _ = pack(size, 4096, None)
    fill = np.bincount(where, size)
    for a, b in itertools.combinations(np.flatnonzero((fill > 0) & (fill < 4096)).tolist(), 2):
        items = size[(where == a) | (where == b)]
        best = max(x for k in range(1 << len(items)) if (x := int(sum(s for i, s in enumerate(items) if k >> i & 1))) <= 4096 and items.sum() - x <= 4096)
        assert best == max(fill[a], fill[b])


def test_query_uses_the_search(spark):
    lengths = np.random.default_rng(3).integers(13, 31, 600)
    docs = spark.createDataFrame([(k, "the " * (int(n) - 1)) for k, n in enumerate(lengths)], "doc_id long, text string")
    rows = pack_documents(docs, WORDS, 1, 64).collect()
    assert check_packed(rows, docs.collect(), 64) < len(best_fit(lengths, 64)[1])


def test_long_texts_and_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "the cat and " * 250_000), (None, "word"), (None, "word"), (4, None)], "doc_id long, text string")
    check_packed(pack_documents(docs, WORDS, 1, 4096).collect(), docs.collect())


def test_pack_keeps_other_columns(spark):
    rows = spark.createDataFrame([(3, "x", 9), (None, "y", 8), (5, "z", 7)], "length long, name string, sequence_id long")
    found = pack_pieces(rows, 5).collect()
    assert sorted((r.name, r.length) for r in found) == [("x", 3), ("y", None), ("z", 5)]
