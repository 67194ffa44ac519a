"""Jaccard join of documents on word n-grams, with Bayesian candidate pruning.

1. A document is its set of five-word shingles (lower case, white space as one blank; a shorter text is one shingle).
   Documents of the same shingle text are copies; one row stands for them, so copies are never compared.
2. Each text has MinHash values. Texts that agree on all values of a band fall into its bucket. In a bucket only
   links to one member are looked at, another one in each band, so a bucket of n texts gives n candidates, not n * n.
3. Candidates are pruned incrementally: after each step of MinHash values, those whose posterior probability of
   reaching the wanted similarity is below TOLERANCE are dropped. What survives ties texts into groups.
4. A bucket whose members came out in different groups is torn. A torn bucket of over TORN members is split by further
   values, several times over, until its parts are small; in a part, members are compared by the same pruning in one
   task, which returns only what joins groups. So no true pair of a bucket is left out, and texts that merely share a
   template are split apart instead of being compared with all others.
5. Groups are cut into blocks of bounded bytes, and each pair of blocks is one task's work: prune by the same rule,
   then compare the survivors' shingles exactly. A task returns counts and links that connect, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.components import components
from rillway.llm.staging import LAST, discard, numbered, plain_words, release, stage, tidy, unused, whole_texts
from rillway.llm.windows import ODD, Windows, mixed

SHINGLE = 5
SIMILAR = 0.8
#: MinHash values; 64 bands of 8 of them: texts of similarity 0.8 miss each other with probability (1 - 0.8 ** 8) ** 64
#: = 8e-6, texts of similarity 0.4 meet in one band with 0.04.
HASHES, BANDS, ROWS = 288, 64, 8
#: Candidates are looked at after each so many MinHash values.
STEP = 32
#: Posterior probability of reaching the similarity below which a pair is dropped.
TOLERANCE = 1e-6
#: Members up to which a torn bucket is compared in one task; how often a larger one is split by SPLIT further values
#: (texts of similarity 0.8 are parted by all splits of one bucket with probability 0.12, and share ten buckets), and
#: how often in turn.
TORN, TRIES, SPLIT, LEVELS = 512, 4, 4, 8
#: Shingles and texts of a block, on average.
BLOCK_SHINGLES, BLOCK = 400_000, 1024

@lru_cache(1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the MinHash functions, from a fixed rule."""
    i = np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * ODD
    v = mixed(i)
    return v[:HASHES] | np.uint64(1), v[HASHES:]


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; empty for a text without words."""
    words = plain_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(words) - SHINGLE + 1)
    data = np.frombuffer(b" ".join(words), np.uint8)
    begin, end = begin[:n], end[min(SHINGLE, len(words)) - 1 :][:n]
    return np.unique(mixed(Windows(data).of(begin, end) + (end - begin).astype(np.uint64) * ODD))


def signature(values: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 32 bits each."""
    a, b = _family()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((min(len(values), 128), HASHES), np.uint64)  # stays in the processor's cache
    for k in range(0, len(values), 128):
        some = values[k : k + 128, None]
        hashed = room[: len(some)]
        np.multiply(some, a, out=hashed)
        hashed += b
        np.minimum(least, hashed.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(1)
def _members_of_bands() -> np.ndarray:
    """The values of each band: every value is used about twice, in bands that have little else in common."""
    order = [np.argsort(mixed(np.arange(HASHES, dtype=np.uint64) + np.uint64(1000 * k + 7))) for k in range(-(-BANDS * ROWS // HASHES))]
    return np.concatenate(order)[: BANDS * ROWS].reshape(BANDS, ROWS)


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band; bands never share keys but by chance."""
    rows = sig[_members_of_bands()].astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * ODD
    for k in range(ROWS):
        key = mixed(key * ODD + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


@lru_cache(None)
def least_matches(similar: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> tuple[int, ...]:
    """After n = step, 2 * step, ... values: the fewest agreeing ones at which a pair stays.

    With a uniform prior the similarity's posterior after m of n agreements is Beta(m + 1, n - m + 1), whose tail
    beyond s is P(Binomial(n + 1, s) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if tail >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return tuple(out)


def plausible(left: np.ndarray, right: np.ndarray, similar: float, tolerance: float) -> np.ndarray:
    """Which pairs of rows of two tables of values survive the incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(similar, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _digest(text: str | None) -> bytes:
    return hashlib.blake2b(b" ".join(plain_words(text or "")), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, row, text): the digest of the words, the number of shingles, the MinHash values' low 16 bits and the bands."""
    release()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text in batch.column(2):
            text = text.as_py() or ""
            own = shingles(text)
            sig = signature(own)
            out[0].append(_digest(text))
            out[1].append(len(own))
            out[2].append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
            out[3].append(bands(sig) if len(own) else np.zeros(0, np.int64))
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], ["doc", "row", "digest", "n", "sig", "bands"])
    tidy()


def _pruned(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that the Bayesian rule leaves."""
    left = signatures.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = signatures.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    # sets whose sizes differ too much can't be similar
    near = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") >= F.lit(SIMILAR) * F.greatest("n_a", "n_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (2, 3))
            good = plausible(left, right, SIMILAR, TOLERANCE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))
        tidy()

    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct ones share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _shared(sets_a: list[np.ndarray], sets_b: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The number of values that sets_a[p] and sets_b[q] share, for each of the pairs."""
    if len(p) <= 4 * (len(sets_a) + len(sets_b)):
        return np.array([_same(sets_a[i], sets_b[j]) for i, j in zip(p.tolist(), q.tolist())], np.int64)
    # many pairs of few texts: products of 0/1 matrices over the values that both sides have, some columns at a time
    rows_a, rows_b = np.unique(p), np.unique(q)
    flat = [np.concatenate([some[k] for k in rows]) for some, rows in ((sets_a, rows_a), (sets_b, rows_b))]
    owner = [np.repeat(np.arange(len(rows)), [len(some[k]) for k in rows]) for some, rows in ((sets_a, rows_a), (sets_b, rows_b))]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    place = [np.searchsorted(shared, x) for x in flat]
    known = [(y < len(shared)) & (shared[np.minimum(y, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for x, y in zip(flat, place)]
    out = np.zeros((len(rows_a), len(rows_b)), np.float32)
    for k in range(0, len(shared), 4096):
        part = []
        for side, rows in enumerate((rows_a, rows_b)):
            here = known[side] & (place[side] >= k) & (place[side] < k + 4096)
            m = np.zeros((len(rows), min(4096, len(shared) - k)), np.float32)
            m[owner[side][here], place[side][here] - k] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out[np.searchsorted(rows_a, p), np.searchsorted(rows_b, q)].astype(np.int64)


def _links(sigs_a, sets_a, sigs_b, sets_b, same_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places (p, q) of all pairs of two blocks with Jaccard SIMILAR at least; p < q within one block."""
    size_a, size_b = (np.array([len(x) for x in some], np.int64) for some in (sets_a, sets_b))
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sets_a)):
        j = np.arange(i + 1 if same_block else 0, len(sets_b))
        j = j[np.minimum(size_a[i], size_b[j]) >= SIMILAR * np.maximum(size_a[i], size_b[j])]
        if len(j):
            j = j[plausible(np.broadcast_to(sigs_a[i], (len(j), HASHES)), sigs_b[j], SIMILAR, TOLERANCE)]
            ps.append(np.full(len(j), i))
            qs.append(j)
    p, q = np.concatenate(ps), np.concatenate(qs)
    if not len(p):
        return p, q
    shared = _shared(sets_a, sets_b, p, q)
    # in integers: shared / union >= 4 / 5
    top, bottom = round(SIMILAR * 1000), 1000
    good = shared * bottom >= top * (size_a[p] + size_b[q] - shared)
    return p[good], q[good]


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place that links join each place to."""
    root = np.arange(n)
    while len(p):
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (before == root).all():
            break
    return root


def _dealt(placed: DataFrame, lots: int, *columns: str) -> DataFrame:
    """Deals the members of keys to tasks: a block of a key of several goes to each pair (i, j), i <= j, of blocks that it is part of; keys of one block share lots.

    placed: key, id, blocks and the columns.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    paired = placed.withColumn("block", block).withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"i": F.least("block", "partner"), "j": F.greatest("block", "partner")})
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(lots))).otherwise(F.xxhash64("key", "i", "j"))
    return paired.select(lot.alias("lot"), "key", "i", "j", "block", "id", *columns)


def _parts_of(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, bool]]:
    """Of a lot: each key's pair of blocks, with the places of the left and of the right block's rows; the two are one in the last case."""
    table = table.sort_by([(c, "ascending") for c in ("key", "i", "j", "block", "id")])
    key, i, j, block = (table.column(c).to_numpy() for c in ("key", "i", "j", "block"))
    begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(key)]):
        yield table.slice(a, b - a), np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a]), bool(i[a] == j[a])


def _compare(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """id, other, links: the links of each text that has any inside its group, counted over copies, and an id that they join it to.

    groups: id, component, n (shingles), copies; texts: id, text. A text has a row for each pair of blocks that it has links in.
    """
    sized = stage(groups.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).where("members > 1"), "sized")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("weight") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")
    placed = groups.join(sized, "component").select(F.col("component").alias("key"), "id", "copies", blocks).join(texts, "id")
    lots = max(1, -(-(sized.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES))

    def pairs(table: pa.Table) -> pa.Table:
        out = []
        for part, left, right, one in _parts_of(table):
            ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
            sets = [shingles(t.as_py() or "") for t in part.column("text")]
            sigs = np.array([signature(x) & np.uint32(0xFFFF) for x in sets])
            p, q = _links(sigs[left], [sets[k] for k in left], sigs[right], [sets[k] for k in right], one)
            p, q = left[p], right[q]
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            some = np.flatnonzero(links)
            out.append((ids[some], ids[_roots(len(ids), p, q)[some]], links[some]))
        tidy()
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["id", "other", "links"])

    pairs.__annotations__ = {}
    return _dealt(placed, lots, "copies", "text").groupBy("lot").applyInArrow(pairs, "id long, other long, links long")


def _joining(table: pa.Table) -> pa.Table:
    """Of parts of torn buckets: a, b for what the incremental comparison leaves between members of different groups, one link for each member at most."""
    out = []
    for part, left, right, one in _parts_of(table):
        ids, component, n = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "component", "n"))
        sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, p in enumerate(left.tolist()):
            q = right[at + 1 :] if one else right
            q = q[(component[q] != component[p]) & (np.minimum(n[p], n[q]) >= SIMILAR * np.maximum(n[p], n[q]))]
            if len(q):
                q = q[plausible(np.broadcast_to(sigs[p], (len(q), HASHES)), sigs[q], SIMILAR, TOLERANCE)]
                ps.append(np.full(len(q), p))
                qs.append(q)
        root = _roots(len(ids), np.concatenate(ps), np.concatenate(qs))
        new = np.flatnonzero(root != np.arange(len(ids)))
        out.append((ids[new], ids[root[new]]))
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["a", "b"])


def _across(inside: DataFrame, group: DataFrame, signatures: DataFrame) -> DataFrame:
    """a, b: likely links between texts of one bucket that are in different groups.

    inside: band, id. A part is a bucket's members that also agree on some further values, so the parts of a large
    bucket of texts that only share a template are small, while similar texts meet in one of them.
    """
    named = inside.join(group, "id", "left").select(F.col("band").alias("key"), "id", F.coalesce("component", "id").alias("component"))
    now, level, found = stage(named, "named"), 0, []
    while True:
        sizes = now.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        sizes = stage(sizes.select("key", "members"), "torn")
        settled = sizes if level == LEVELS else sizes.where(F.col("members") <= TORN)
        small = now.join(settled, "key").select("key", "id", "component", F.ceil(F.col("members") / F.lit(TORN)).cast("int").alias("blocks"))
        found.append(small)
        large = sizes.where(F.col("members") > TORN)
        if level == LEVELS or not large.limit(1).count():
            break
        level += 1
        split = now.join(large.select("key"), "key").join(signatures.select("id", "sig"), "id").withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(TRIES))))
        at = F.pmod(F.xxhash64("key", "try", F.lit(level)), F.lit(HASHES // SPLIT)).cast("int") * (2 * SPLIT) + 1
        now = stage(split.select(F.xxhash64("key", "try", F.substring("sig", at, F.lit(2 * SPLIT))).alias("key"), "id", "component"), "parts")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = stage(every, "apart")
    lots = max(1, -(-every.count() // 4096))
    placed = every.join(signatures, "id")
    return _dealt(placed, lots, "component", "n", "sig").groupBy("lot").applyInArrow(_joining, "a long, b long")


def _classes(own: DataFrame) -> DataFrame:
    """Of (doc, row, text): doc, row, class_id, copy_id, n_links, and first, whether the row is the first of its class, for every row."""
    whole_texts(own.sparkSession)
    table = stage(own.mapInArrow(_sketch, "doc long, row long, digest binary, n int, sig binary, bands array<long>"), "sketches")
    # one row for all copies
    distinct = table.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("copy"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stage(distinct.select(F.monotonically_increasing_id().alias("id"), "digest", "copy.*", "copies", "n", "sig", "bands"), "texts")
    signatures = reps.select("id", "n", "sig")
    members = reps.select("id", F.explode("bands").alias("band"))
    # each band has another member of a bucket as its centre
    centre = F.min(F.struct(F.xxhash64("id", "band").alias("h"), F.col("id").alias("id")))["id"]
    buckets = stage(members.groupBy("band").agg(centre.alias("centre"), F.count("*").alias("held")).where("held > 1").select("band", "centre"), "buckets")
    inside = stage(members.join(buckets, "band"), "members")
    stars = inside.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    tied = stage(_pruned(stars, signatures), "tied")
    group = stage(components(tied), "groups")
    more = stage(_across(inside.select("band", "id"), group, signatures), "across")
    discard(buckets, inside)
    if more.limit(1).count():
        group = stage(components(tied.union(more)), "groups")
    # the text of one copy for each text that is in a group
    chosen = stage(group.join(reps.select("id", "doc", "row"), "id").select("id", "doc", "row"), "chosen")
    texts = own.join(chosen, ["doc", "row"]).select("id", "text")
    found = stage(_compare(group.join(reps.select("id", "n", "copies"), "id"), texts), "found")
    joined = components(found.where("other <> id").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_text = reps.select("id", "digest", F.struct("doc", "row").alias("copy"), "copies").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = stage(of_text.groupBy("component").agg(F.min("copy").alias("lead")), "smallest")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    classes = stage(of_text.join(smallest, "component").join(counts, "id", "left").select("digest", "lead", F.col("copy.doc").alias("copy_id"), links), "classes")
    discard(tied, more, group, chosen, found, reps, smallest)
    worded = table.where("n > 0").select("doc", "row", "digest").join(classes, "digest")
    worded = worded.select("doc", "row", F.col("lead.doc").alias("class_id"), "copy_id", "n_links", (F.struct("doc", "row") == F.col("lead")).alias("first"))
    alone = table.where("n = 0").select("doc", "row", F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return worded.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_links for every row of docs.

    class_id is the smallest doc_id among the rows that links join, directly or through others; copy_id the smallest
    among those with the same words. n_links counts the other rows of Jaccard similarity SIMILAR at least, copies
    included. Null texts, and texts without words, resemble nothing: each is a class of its own without links. A
    null doc_id stays null and ranks after all others. Rows that repeat are copies of each other; rows of one doc_id
    with other words are texts of their own. Other columns, whatever their names, aren't read. An empty table gives
    no rows.
    """
    own = numbered(docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").alias("text")), "own_id", "doc", "row").select("doc", "row", "text")
    known = lambda c: F.when(F.col(c) < F.lit(LAST), F.col(c))
    return _classes(own).select(known("doc").alias("doc_id"), known("class_id").alias("class_id"), known("copy_id").alias("copy_id"), "n_links")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that have an earlier one in their class; one row of each class stays, with all its columns.

    Earlier is the smaller id (null last), then the lower row number. Rows are told apart by both, so rows of null or
    shared ids are texts of their own, and go only as copies. Texts without words all stay. An empty table stays empty.
    """
    names = docs.columns
    doc, row = unused(names, "doc", "row")
    every = numbered(docs, id_col, doc, row)
    decided = _classes(every.select(F.col(doc).alias("doc"), F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")))
    gone = stage(decided.where("not first").select(F.col("doc").alias(doc), F.col("row").alias(row)), "gone")
    return every.join(gone, [doc, row], "left_anti").select(*(F.col(f"`{c}`") for c in names))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's class and links; nulls, ties, repeated rows and empty tables as in near_duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
