"""Token-id output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

A shard holds the documents of one range of ids, in ascending order: NAME.bin has the ids one after another
(2 bytes each while the vocabulary allows, else 4), NAME.idx the places of the documents' ends as signed 64-bit
integers from 0 on, NAME.doc the document ids as 64-bit integers and NAME.nul a byte for each document that is 1
where its id is null. A shard's base, the number of ids before it, comes from prefix sums over the shards' sizes;
one row for each shard is all that the driver sees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import new_path, numbered, tidy, whole_texts
from rillway.llm.encoding import encoder, in_groups, larger

_SHARD = "shard long, name string, width int, n_docs long, n_tokens long"


def file_system(uri: str):
    """The store and the path in it; a plain path is the local file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _put(store, path: str, attempt: str, parts: Iterator[bytes]) -> None:
    """Written under another name first, so a failed or repeated task never leaves half a file."""
    with store.open_output_stream(f"{path}.{attempt}") as out:
        for part in parts:
            out.write(part)
    store.move(f"{path}.{attempt}", path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, writes shards under path and returns one row for each shard.

    Documents are in ascending order of their id, null ids last; rows that share an
    id, or have none, are in the order of their row numbers and in as many shards as they need. A null text is empty, so its document has the end id alone. An empty table gives no shard. Other columns of
    docs, whatever their names, are not read.
    """

    whole_texts(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        k, attempt = context.partitionId(), f"try{context.taskAttemptId()}"
        store, base = file_system(path)
        encode = encoder(tokenizer, True, 500_000)  # alone in its workers, it can hold more
        kind = np.dtype("<u2" if max(encode.vocabulary - 1, end_id) < 1 << 16 else "<u4")
        sizes, names, nulls = [], [], []
        end = np.array([end_id], kind).tobytes()

        def ids() -> Iterator[bytes]:
            for batch in larger(batches, 5_000_000):
                names.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1"))
                texts = batch.column(1).to_pylist()
                for a, b in in_groups(texts, 5_000_000):
                    found = encode.encode([x or "" for x in texts[a:b]])
                    sizes.extend(len(x) + 1 for x in found)
                    yield b"".join(part for x in found for part in (x.astype(kind).tobytes(), end))

        first = next(parts := ids(), None)
        if first is None:
            return
        name = f"{base}/shard-{k:06d}"
        store.create_dir(base, recursive=True)
        _put(store, f"{name}.bin", attempt, (x for some in ((first,), parts) for x in some))
        tidy()
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, "<i8"))]).astype("<i8")
        _put(store, f"{name}.idx", attempt, iter([ends.tobytes()]))
        _put(store, f"{name}.doc", attempt, iter([np.concatenate(names).tobytes()]))
        _put(store, f"{name}.nul", attempt, iter([np.concatenate(nulls).tobytes()]))
        yield pa.RecordBatch.from_pydict({"shard": [k], "name": [f"shard-{k:06d}"], "width": pa.array([kind.itemsize], pa.int32()), "n_docs": [len(sizes)], "n_tokens": [int(ends[-1])]})

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = numbered(narrow, "id", "doc", "row")
    dealt = known.repartitionByRange("doc", "row").sortWithinPartitions("doc", "row").select("id", "text")
    made = dealt.mapInArrow(shard, _SHARD).collect()  # a row for each shard
    bases, total = [], 0
    for row in sorted(made):
        bases.append((*row, total))
        total += row.n_tokens
    return docs.sparkSession.createDataFrame(bases, _SHARD + ", base long")


class _Flat:
    """A flat file of numbers, of which slices are read: through a memory map where the store is local, else by ranged reads."""

    def __init__(self, store, path: str, kind: str):
        from pyarrow import fs

        self.kind = np.dtype(kind)
        self.size = store.get_file_info(path).size // self.kind.itemsize
        self.map = self.file = None
        if isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, dtype=kind, mode="r") if self.size else np.zeros(0, kind)
        else:
            self.file = store.open_input_file(path)

    def part(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


#: Documents, and ids unless one document has more, that a reader holds at a time.
READ_DOCS, READ_IDS = 4096, 4_000_000


def read_token_files(spark: SparkSession, path: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each document from the files alone: doc_id, start, n_tokens, ids_crc32, and ids if wanted."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['name']}"
                ids = _Flat(store, f"{name}.bin", "<u2" if row["width"] == 2 else "<u4")
                ends, docs, null = _Flat(store, f"{name}.idx", "<i8"), _Flat(store, f"{name}.doc", "<i8"), _Flat(store, f"{name}.nul", "u1")
                a = 0
                while a < docs.size:
                    at = np.asarray(ends.part(a, min(a + READ_DOCS, docs.size) + 1))
                    b = a + max(1, int(np.searchsorted(at, at[0] + READ_IDS, side="right")) - 1)
                    at = at[: b - a + 1]
                    held = np.asarray(ids.part(int(at[0]), int(at[-1]))).astype("<u4")
                    own = [held[x:y] for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist())]
                    columns = [
                        pa.array(np.asarray(docs.part(a, b)), pa.int64(), mask=np.asarray(null.part(a, b)).astype(bool)),
                        pa.array(row["base"] + at[:-1], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ] + [pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, names)
                    a = b

    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(read, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, written with the 50k byte-level vocabulary and read back; nulls, repeats and empty tables as in write_token_files."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path, shards)
