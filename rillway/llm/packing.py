"""Best-fit packing of token pieces into sequences, improved by swaps between underfull sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import stage, tidy, unused, whole_texts
from rillway.llm.encoding import encoder, in_groups, larger

#: Pieces that one task packs together. Blocks grow in number with the input, never in size.
BLOCK_PIECES = 65_536
#: Passes of the search in one block that may go by without a sequence being emptied; None: until no exchange is left.
PATIENCE = 300
#: Two sequences of so many pieces together exchange any of them; of larger ones the PROBES largest pieces are looked at.
SMALL, PROBES = 9, 32

#: Characters of texts that are encoded together, and pieces that a worker remembers: fewer take less memory and more time.
GROUP_CHARS, REMEMBERED = 5_000_000, 500_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and the room left in each sequence: by falling length into the fullest sequence with room.

    mask has a bit for each amount of room that some sequence has, so the best fit is its lowest bit from the length on.
    """
    where, rooms, by_room, mask = np.zeros(len(size), np.int64), [], [[] for _ in range(capacity + 1)], 0
    for x in np.argsort(-size, kind="stable").tolist():
        n = int(size[x])
        wide = mask >> n
        if wide:
            room = n + (wide & -wide).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            k, room = len(rooms), capacity
            rooms.append(0)
        rooms[k] = room - n
        by_room[room - n].append(k)
        mask |= 1 << (room - n)
        where[x] = k
    return where, np.array(rooms, np.int64)


class _Search:
    """Swap-based local search from a packing. A pass pairs underfull sequences; each pair makes the exchange that gives the greatest sum of squared fill.

    Two sequences of few pieces try all ways to share them, so moves, one for one, two for one and any other exchange.
    Of others the PROBES largest pieces move alone or in neighbouring twos, for none, one or two of the other's.
    """

    def __init__(self, size: np.ndarray, where: np.ndarray, room: np.ndarray, capacity: int):
        self.size, self.where, self.capacity = size, where, capacity
        self.fill = capacity - room

    def exchange(self, a: np.ndarray, b: np.ndarray) -> bool:
        """One exchange in each pair (a[k], b[k]) that has one; whether there was any."""
        self.order = np.argsort(self.where, kind="stable")
        self.count = np.bincount(self.where, minlength=len(self.fill))
        self.start = np.cumsum(self.count) - self.count
        total = self.count[a] + self.count[b]
        some = False
        for t in range(2, SMALL + 1):
            of = np.flatnonzero(total == t)
            for k in range(0, len(of), 2048):
                some |= self.share(a[of[k : k + 2048]], b[of[k : k + 2048]], t)
        of = np.flatnonzero(total > SMALL)
        for k in range(0, len(of), 256):
            some |= self.trade(a[of[k : k + 256]], b[of[k : k + 256]])
        return some

    def share(self, a: np.ndarray, b: np.ndarray, t: int) -> bool:
        """Shares the t pieces of each pair so that a is as full as can be."""
        nth = np.arange(t)[None, :]
        own = self.count[a][:, None]
        items = self.order[np.where(nth < own, self.start[a][:, None] + nth, self.start[b][:, None] + nth - own)]
        sizes = self.size[items]
        masks = (np.arange(1 << t)[:, None] >> np.arange(t)) & 1
        sums, total = sizes @ masks.T, sizes.sum(axis=1)
        sums[(sums > self.capacity) | (total[:, None] - sums > self.capacity)] = -1
        best = sums.argmax(axis=1)
        most = sums[np.arange(len(a)), best]
        good = np.flatnonzero(most > np.maximum(self.fill[a], self.fill[b]))
        if not len(good):
            return False
        a, b, most = a[good], b[good], most[good]
        self.where[items[good]] = np.where(masks[best[good]] > 0, a[:, None], b[:, None])
        self.fill[a], self.fill[b] = most, total[good] - most
        return True

    def probes(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sequence: what may leave it, as two pieces (-1 for none) and their size (0 for nothing; the first of all)."""
        held = [self.order[self.start[x] : self.start[x] + self.count[x]] for x in k.tolist()]
        one = np.full((len(k), PROBES), -1)
        for row, pieces in enumerate(held):
            largest = pieces[np.argsort(-self.size[pieces], kind="stable")[:PROBES]]
            one[row, : len(largest)] = largest
        none = np.full((len(k), 1), -1)
        first, second = np.concatenate([none, one, one[:, :-1]], axis=1), np.concatenate([none, np.full_like(one, -1), one[:, 1:]], axis=1)
        first[:, PROBES + 1 :][second[:, PROBES + 1 :] < 0] = -1  # half a two is nothing
        sized = np.append(self.size, 0)
        return first, second, sized[first] + np.where(first < 0, 0, sized[second])

    def trade(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Moves as many tokens as fit from the emptier to the fuller of each pair by one exchange."""
        swap = self.fill[a] > self.fill[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out, back = self.probes(a), self.probes(b)
        gain = out[2][:, :, None] - back[2][:, None, :]
        gain[gain > (self.capacity - self.fill[b])[:, None, None]] = -1
        best = gain.reshape(len(a), -1).argmax(axis=1)
        i, j, row = best // back[2].shape[1], best % back[2].shape[1], np.arange(len(a))
        most = gain[row, i, j]
        good = np.flatnonzero(most > 0)
        for moved, at, to in ((out, i, b), (back, j, a)):
            for pieces in moved[:2]:
                gone = pieces[good, at[good]]
                self.where[gone[gone >= 0]] = to[good][gone >= 0]
        self.fill[a[good]] -= most[good]
        self.fill[b[good]] += most[good]
        return len(good) > 0

    def run(self, patience: int | None) -> None:
        """Passes until the fewest possible sequences are left, no pair has an exchange, or too many passes emptied none.

        The passes are rounds of a tournament, so every pair of underfull sequences meets. Reruns meet alike.
        """
        least, quiet = -(-int(self.size.sum()) // self.capacity), 0
        used = int((self.fill > 0).sum())
        rng = np.random.default_rng(len(self.size))
        while used > least:
            bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            rng.shuffle(bins)
            if len(bins) % 2:
                bins = np.append(bins, -1)
            changed, half = False, len(bins) // 2
            for _ in range(len(bins) - 1):
                a, b = bins[:half], bins[half:][::-1]
                open_ = (a >= 0) & (b >= 0)
                open_ &= (self.fill[a] > 0) & (self.fill[b] > 0) & (self.fill[a] < self.capacity) & (self.fill[b] < self.capacity)
                changed |= self.exchange(a[open_], b[open_])
                bins[1:] = np.roll(bins[1:], 1)
                now = int((self.fill > 0).sum())
                quiet = 0 if now < used else quiet + 1
                used = now
                if used <= least or patience is not None and quiet > patience:
                    return
            if not changed:
                return


def pack(lengths: np.ndarray, capacity: int, patience: int | None = PATIENCE) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each piece: best fit by falling length, then swap-based local search.

    The search pairs underfull sequences and lets each pair move or exchange pieces so that the fuller one gets as full
    as can be. Each exchange raises the sum of squared fill, so the search ends; on the way sequences are emptied.
    """
    size = np.asarray(lengths, np.int64)
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, room = best_fit(size, capacity)
    search = _Search(size, where, room, capacity)
    search.run(patience)
    order = np.argsort(search.where, kind="stable")
    sums = np.cumsum(size[order]) - size[order]
    first = np.flatnonzero(np.diff(search.where[order], prepend=-1))
    offset = np.zeros(len(size), np.int64)
    offset[order] = sums - np.repeat(sums[first], np.diff(np.append(first, len(size))))
    return search.where, offset


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_chars: int = GROUP_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece of a document's ids (with end_id); only documents of over capacity ids are cut."""
    whole_texts(docs.sparkSession)
    schema = _PIECES + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False, remembered)
        end = np.array([end_id], np.int64)
        for batch in larger(batches, group_chars):
            docs_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts, group_chars):
                rows: list[tuple] = []
                for doc, ids in zip(docs_of[a:b], encode.encode([x or "" for x in texts[a:b]])):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        rows.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes()), part)[: len(names)])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset (long) to rows of 0 to capacity tokens; every row is placed once.

    Rows are dealt at random into blocks of about BLOCK_PIECES and each block is packed by itself, which costs at
    most one underfull sequence more for each block. No key decides where a row goes, so equal rows, hot sources and
    copies are spread, and a block has lengths alone, whatever else the rows hold. An empty table gives an empty
    table; a null length counts as 0.
    """
    pieces = pieces.drop("sequence_id", "offset")
    row, of = unused([*pieces.columns, "sequence_id", "offset"], "row", "of")
    placed = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    length = F.coalesce(F.col(f"`{length_col}`"), F.lit(0)).cast("long")
    rest = placed.where(length < capacity).select(F.col(row).alias("row"), length.alias("length"))
    blocks = max(1, -(-rest.count() // BLOCK_PIECES))

    def place(key, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        where, offset = pack(table.column("length").to_numpy(), capacity)
        return pa.table([table.column("row"), pa.array((key[0].as_py() << 32) + where), pa.array(offset)], names=["row", "sequence_id", "offset"])

    place.__annotations__ = {}
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block")
    packed = dealt.applyInArrow(place, "row long, sequence_id long, offset long").withColumnRenamed("row", of)
    found = stage(packed, "packed")
    alone = placed.where(length >= capacity).withColumns({"sequence_id": -1 - F.col(row), "offset": F.lit(0).cast("long")}).drop(row)
    return placed.join(found, F.col(row) == F.col(of)).drop(row, of).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_chars: int = GROUP_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """Packs every whole text into sequences of at most capacity ids.

    A null or empty text is its end id alone. Rows that repeat, or share a doc_id, are documents of their own. A
    null doc_id stays null. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, group_chars, remembered), capacity)


def pack_for_training(docs: DataFrame, group_chars: int = GROUP_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """Production parameters: 49k word pieces, end id 1, sequences of 4096."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, group_chars=group_chars, remembered=remembered)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of documents and its place; nulls, repeated rows and empty tables as in pack_documents."""
    return pack_for_training(spark.read.parquet(f"{sf_dir}/documents.parquet"))
