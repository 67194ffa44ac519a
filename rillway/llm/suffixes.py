"""Removal of repeated byte strings by distributed prefix doubling on a thinned set of positions.

Plain prefix doubling sorts every position of the corpus in every round. Here positions are thinned before the first:
of the places where a window of THRESHOLD bytes holds a string of FIRST bytes, the one with the smallest fingerprint is
the window's anchor. Equal windows have equal anchors at equal places, and neighbouring windows share theirs. An
anchor's context is all its windows together, up to 2 * THRESHOLD - FIRST bytes.

Spark sorts the anchors' rank pairs at growing offsets: first their first FIRST bytes, of which those that are unique go
with their windows; then pairs of that rank and what stands at the offset FIRST, then of the new rank and what stands at
twice that, up to the context's end, which is past the threshold; then of that rank and what stands before the anchor.
Anchors of equal last ranks have equal contexts, so these are repeats with all their windows. What stands at an offset
goes by its fingerprint, which a position gets from prefix sums without asking other positions.

Where an anchor's first rank has different contexts, one context of each kind is cut into its windows, and these are
counted; it settles the edges of repeats.

repeated_starts is the plain form, for tables small enough to bear it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import LAST, discard, numbered, stage, tidy, whole_texts, with_rank
from rillway.llm.windows import ODD, Windows, mixed

THRESHOLD = 200
FIRST = 64
#: Bytes that are looked at together; a longer text is several such parts that overlap by a window.
PART = 1 << 20
#: Contexts of one name that are looked at in one task.
TOGETHER = 2000
_PLACE_BITS = 30
def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _parts(data: bytes, threshold: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts that together hold every window once."""
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, max(1, len(raw) - threshold + 1), size):
        yield a, raw[a : a + size + threshold - 1]


def anchors(data: bytes, threshold: int, first: int, size: int = PART) -> Iterator[tuple[np.ndarray, ...]]:
    """For each part: anchor's place, first and last start of its windows, and fingerprints: of its first bytes, of the next as many, of the rest of its context, and of what its context has before it."""
    keep = ~np.uint64((1 << _PLACE_BITS) - 1)
    for a, part in _parts(data, threshold, size):
        if len(part) < threshold:
            continue
        name, other = Windows(part, 1), Windows(part, 2)
        every = name.all(first)
        # the fingerprint's leading bits, then the place: the smallest is the leftmost of equals
        packed = (every & keep) | np.arange(len(every), dtype=np.uint64)
        place = (_sliding_minimum(packed, threshold - first + 1) & ~keep).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.append(begin[1:], len(place)) - 1
        at = place[begin]
        stop = end + threshold
        second = np.minimum(at + 2 * first, stop)
        after = [other.of(x, y) + (y - x).astype(np.uint64) * ODD for x, y in ((at + first, second), (second, stop), (begin, at))]
        yield at + a, begin + a, end + a, every[at].view(np.int64), *(mixed(x).view(np.int64) for x in after)


_ANCHORS = "doc long, h long, place long, name long, next long, rest long, left long"
#: An anchor's place and its windows' first and last start in one number; these start at most 2**16 - 1 bytes before it.
_BEGIN, _END = "(place >> 32) - (place >> 16 & 65535)", "(place >> 32) - (place & 65535)"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that Python holds few texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _find_anchors(threshold: int, first: int, size: int):
    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["doc", "h", "place", "name", "next", "rest", "left"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            held: list[tuple] = []
            rows_held = 0
            for doc, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at, lo, hi, *names in anchors((text or "").encode("utf-8", "surrogatepass"), threshold, first, size):
                    n = len(at)
                    held.append((np.full(n, doc, np.int64), np.full(n, h, np.int64), at << 32 | (at - lo) << 16 | (at - hi), *names))
                    rows_held += n
                if rows_held > 200_000:
                    yield batch_of(held)
                    held, rows_held = [], 0
            if held:
                yield batch_of(held)
        tidy()

    return rows


def _contexts(threshold: int):
    """Of (doc, h, body, wanted): a row for each wanted context with its bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[tuple] = []
            for doc, h, body, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = _unpacked(body)
                for x in wanted:
                    at, lo, hi = x["place"] >> 32, x["place"] >> 16 & 0xFFFF, x["place"] & 0xFFFF
                    out.append((doc, h, at - lo, lo, x["name"], x["kinds"], x["times"] > 1, data[at - lo : at - hi + threshold]))
                if len(out) > 5_000:
                    yield _context_batch(out)
                    out = []
            if out:
                yield _context_batch(out)

    return rows


_CONTEXTS = "doc long, h long, begin long, before int, name long, kinds long, known boolean, bytes binary"


def _context_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc", "h", "begin", "before", "name", "kinds", "known", "bytes"])


def _window_names(begin_in: np.ndarray, size: np.ndarray, before: np.ndarray, name: np.ndarray, data: bytes, threshold: int) -> tuple[np.ndarray, ...]:
    """Of contexts that lie in data at begin_in: for each of their windows the context, the start in it, and the name of window, place and anchor."""
    names = Windows(np.frombuffer(data, np.uint8), 2)
    n = size - threshold + 1
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    p = begin_in[owner] + start
    window = names.of(p, p + threshold)
    key = mixed(window + (before[owner] - start).astype(np.uint64) * ODD) ^ name[owner].astype(np.int64).view(np.uint64)
    return owner, start, mixed(key + ODD)


def _columns(table) -> tuple[np.ndarray, ...]:
    sizes = np.fromiter((len(x) for x in table.column("bytes").to_pylist()), np.int64, table.num_rows)
    return np.cumsum(sizes) - sizes, sizes, table.column("before").to_numpy().astype(np.int64), table.column("name").to_numpy(), b"".join(table.column("bytes").to_pylist())


def _resolve(threshold: int):
    """Of all contexts of some names: the spans of windows that occur in two of them, for those that aren't known as repeats."""

    def spans(table):
        owner, start, key = _window_names(*_columns(table), threshold)
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        known = table.column("known").to_numpy(zero_copy_only=False).astype(bool)
        hit = np.flatnonzero((count[where] > 1) & ~known[owner])
        new = np.flatnonzero(np.concatenate([[True], (owner[hit][1:] != owner[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)])) if len(hit) else hit
        last = np.append(new[1:], len(hit)) - 1 if len(hit) else new
        own, begin = owner[hit[new]], table.column("begin").to_numpy()
        columns = [table.column("doc").to_numpy()[own], table.column("h").to_numpy()[own], begin[own] + start[hit[new]], begin[own] + start[hit[last]] + threshold]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc", "h", "lo", "hi"])

    return spans


def _windows(threshold: int):
    """Of contexts: a row for each window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                table = pa.Table.from_batches([batch.slice(a, 1000)])
                owner, start, key = _window_names(*_columns(table), threshold)
                columns = [table.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("doc", "h", "begin", "name", "known")]
                columns[2] = columns[2] + start
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(key.view(np.int64))], ["doc", "h", "lo", "name", "known", "key"])

    return rows


def _packed(docs: DataFrame) -> DataFrame:
    """doc, h, body: texts as they are moved between executors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _slices(batches):
            bodies = [pack((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["doc", "h", "body"])

    return docs.mapInArrow(rows, "doc long, h long, body binary")


def _unpacked(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def _cut(docs_of: pa.RecordBatch, with_bytes: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for doc, h, body, spans in zip(*(c.to_pylist() for c in docs_of.columns)):
        data = _unpacked(body)
        n_removed, runs = 0, []
        if spans:
            spans = np.array([(x["lo"], x["hi"]) for x in spans], np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            reach = np.maximum.accumulate(spans[:, 1])
            new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
            runs = list(zip(spans[new, 0].tolist(), reach[np.append(new[1:], len(spans)) - 1].tolist()))
            n_removed = sum(b - a for a, b in runs)
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        else:
            kept = data
        out.append((None if doc == LAST else doc, len(data), n_removed, len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"begin": a, "end": b} for a, b in runs]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
    n = len(names) if with_bytes else 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out))[:n], kinds)], names[:n])


def _reranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a new rank, the place of their pair of by in the order of all such pairs, instead of the pair."""
    # counts are staged before they are joined: so both sides are dealt anew, and a hot pair's rows can be split
    ranked = with_rank(rows.select(*by).distinct(), [F.col(c) for c in by], "new", "ranks")
    out = stage(rows.join(ranked, by).drop(*by).withColumnRenamed("new", "rank"), "ranked")
    discard(rows, ranked)
    return out


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, part: int = PART, together: int = TOGETHER) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_bytes adds kept (binary) and spans.

    A byte is removed if it lies in a string of threshold bytes that starts at another place too, in the same text or
    another. Everything is judged on the input. A null text is empty; texts shorter than threshold keep everything.
    Rows that repeat, or share an id, or have none, are further places, so they lose what they share; a null doc_id
    stays null. Other columns, whatever their names, aren't read. An empty table gives no rows.
    """
    whole_texts(docs.sparkSession)
    own = numbered(docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").alias("text")), "own_id", "doc", "h").select("doc", "h", "text")
    found = stage(own.mapInArrow(_find_anchors(threshold, first, part), _ANCHORS), "anchors")
    # offset 0: what occurs once is gone
    names = stage(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "names")
    ranks = with_rank(names, [F.col("name")], "first", "ranks")
    now = stage(found.join(ranks, "name").drop("name").withColumn("rank", F.col("first")), "repeated")
    discard(found, names, ranks)
    # the offsets first and 2 * first, and what stands before
    for part_of in ("next", "rest", "left"):
        now = _reranked(now, ["rank", part_of])
    one = F.min(F.struct("doc", "h", "place"))
    contexts = stage(now.groupBy(F.col("first").alias("name"), F.col("rank").alias("context")).agg(F.count("*").alias("times"), one.alias("one")), "contexts")
    whole = now.join(contexts.where("times > 1").select(F.col("context").alias("rank")), "rank", "left_semi")
    spans = stage(whole.select("doc", "h", F.expr(_BEGIN).alias("lo"), (F.expr(_END) + threshold).alias("hi")), "whole")
    discard(now)
    # windows of one context of each kind, where a first rank has several kinds
    several = stage(contexts.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    chosen = contexts.join(several, "name").select("one.*", "name", "kinds", "times")
    by_text = chosen.groupBy("doc", "h").agg(F.collect_list(F.struct("place", "name", "kinds", "times")).alias("wanted"))
    opened = _packed(own).join(by_text, ["doc", "h"]).select("doc", "h", "body", "wanted")
    opened = stage(opened.mapInArrow(_contexts(threshold), _CONTEXTS), "opened")
    discard(contexts, several)
    # the contexts of a name come together in one task; names of very many contexts are counted window by window
    few = opened.where(F.col("kinds") <= together)
    lots = max(1, opened.count() // 4000)
    lot = F.pmod(F.xxhash64("name"), F.lit(lots)).alias("lot")
    edges = few.select(lot, "doc", "h", "begin", "before", "name", "known", "bytes").groupBy("lot").applyInArrow(_resolve(threshold), "doc long, h long, lo long, hi long")
    many = opened.where(F.col("kinds") > together)
    if many.limit(1).count():
        windows = stage(many.select("doc", "h", "begin", "before", "name", "known", "bytes").mapInArrow(_windows(threshold), "doc long, h long, lo long, name long, known boolean, key long"), "windows")
        counted = stage(windows.groupBy("name", "key").agg(F.count("*").alias("n")).where("n > 1").select("name", "key"), "counted")
        alike = windows.where("not known").join(counted, ["name", "key"], "left_semi")
        edges = edges.union(alike.select("doc", "h", "lo", (F.col("lo") + threshold).alias("hi")))
    by_doc = stage(spans.union(edges).groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(spans, opened)
    every = _packed(own).join(by_doc, ["doc", "h"], "left").select("doc", "h", "body", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<begin:long,end:long>>" * with_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield _cut(batch, with_bytes)
        tidy()

    return every.mapInArrow(cut, schema)


def repeated_starts(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, at: where strings of threshold bytes start that start elsewhere too, by plain prefix doubling; ids must be unique.

    Every position has a rank for its first bytes; each round sorts pairs of a position's rank and that at the growing
    offset, ranks the pairs anew and drops the positions whose pair is unique, until threshold bytes are ranked. It
    moves each position several times in the first rounds, tens of times the input, so remove_repeats thins the
    positions first; tests hold the two against each other.
    """
    length = min(8, threshold)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                n = len(raw) - length + 1
                if n > 0:
                    rank = sum(raw[k : k + n] << 8 * (length - 1 - k) for k in range(length))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc, np.int64)), pa.array(np.arange(n)), pa.array(rank)], ["doc", "at", "rank"])

    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))
    now = own.mapInArrow(starts, "doc long, at long, rank long").withColumn("next", F.lit(0).cast("long"))
    while True:
        pairs = now.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
        ranked = with_rank(pairs, [F.col("rank"), F.col("next")], "new", "ranks")
        kept = stage(now.join(ranked, ["rank", "next"]).select("doc", "at", F.col("new").alias("rank")), "positions")
        if length == threshold:
            return kept.select("doc", "at")
        step = min(length, threshold - length)
        now = kept.join(kept.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("next")), ["doc", "at"])
        length += step


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's bytes and what goes of them; nulls, repeats and empty tables as in remove_repeats."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
