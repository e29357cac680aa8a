"""Token-ID output: Arrow IPC streams of fixed-size-list batches with equal-length sequences and masks.

Layout. Documents in ascending id order form one stream of ids, cut into shards. A shard file is an
Arrow IPC stream with the columns `ids` (fixed_size_list of uint16 or uint32) and `mask`
(fixed_size_list of bool, packed bits), every batch but the last with the same number of rows, so row
i of a memory-mapped file is a slice of one buffer. Only a shard's last row is padded (mask false).
The header's metadata holds the shard's document index, itself an Arrow stream (doc_id, start, n_tokens).

A `manifest` table beside the data lists the files of committed tasks, so files of lost or repeated
attempts are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, make_dir, open_fs, pieces, shared_dir, slices, strings
from .tokens import worker_tokenizer

SEQUENCE = 2048
ROWS_A_BATCH = 256
SHARD_TOKENS = 4 << 20


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def write_shard(uri: str, ids: np.ndarray, doc_ids: list, lens: np.ndarray, length: int = SEQUENCE) -> None:
    """Writes one shard under a temporary name and then moves it into place."""
    index = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "start": np.cumsum(lens) - lens, "n_tokens": lens})
    rows = -(-len(ids) // length)
    padded = np.zeros(rows * length, ids.dtype)
    padded[: len(ids)] = ids
    kind = pa.from_numpy_dtype(ids.dtype)
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {b"documents": _ipc(index), b"n_tokens": str(len(ids)).encode()})
    real = np.arange(rows * length) < len(ids)
    fs, path = open_fs(uri)
    with fs.open_output_stream(path + ".tmp") as sink, pa.ipc.new_stream(sink, schema) as out:
        for at in range(0, rows, ROWS_A_BATCH):
            cut = slice(at * length, min(rows, at + ROWS_A_BATCH) * length)
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded[cut]), length), pa.FixedSizeListArray.from_arrays(pa.array(real[cut]), length)], schema=schema))
    fs.move(path + ".tmp", path)


class Shard:
    """Random access to a shard: rows are views of the (memory-mapped) file, never copies."""

    def __init__(self, source: pa.Buffer | str) -> None:
        if isinstance(source, str):
            fs, path = open_fs(source)
            source = pa.memory_map(path).read_buffer()
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        meta = reader.schema.metadata
        self.documents = pa.ipc.open_stream(meta[b"documents"]).read_all()
        self.n_tokens = int(meta[b"n_tokens"])
        self.length = reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = divmod(i, ROWS_A_BATCH)
        b = self.batches[batch]
        ids = b.column(0)
        lo = (ids.offset + row) * self.length
        return ids.values.to_numpy()[lo : lo + self.length], b.column(1).values.slice((b.column(1).offset + row) * self.length, self.length)

    def ids(self) -> np.ndarray:
        parts = [b.column(0).flatten().to_numpy() for b in self.batches]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16))[: self.n_tokens]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, shard_tokens: int = SHARD_TOKENS, wide: bool = False) -> None:
    """Encodes doc_id, text (null: empty) into `path`/data with a committed `path`/manifest.

    Rows go out in ascending (doc_id, text) order, null ids first; repeated ids stay separate
    documents. An empty table gives an empty manifest. Other columns are ignored. ids are
    uint16, or uint32 with `wide` (vocabularies over 65,536). A shard is closed once it has
    `shard_tokens`, looked at after every 4 MB of texts or one longer text, so that bounds it and the task's memory.
    """
    data = make_dir(f"{path}/data")
    kind = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer)
        part, seq, held, lens, names, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:07d}-{seq:05d}-{uuid.uuid4().hex}.arrows"
            write_shard(f"{data}/{name}", np.concatenate(held).astype(kind), names, np.concatenate(lens), length)
            return pa.record_batch({"file": [name], "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "n_tokens": pa.array([size], pa.int64())})

        for batch in batches:
            for at, texts in slices(strings(batch.column(1)), 4 << 20):
                ids, offs = encoder.encode(texts, end_id)
                held.append(ids)
                lens.append(np.diff(offs))
                names += batch.column(0).slice(at, len(texts)).to_pylist()
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
                    seq, held, lens, names, size = seq + 1, [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(pieces(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, "file string, part long, seq long, n_tokens long").write.mode("overwrite").parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, include_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                ids, index = shard.ids().astype("<u4"), shard.documents
                start, n = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                views = [ids[a : a + b] for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                out = {"file": pa.array([name] * len(n)), "doc_id": index["doc_id"].combine_chunks(), "at": start, "n_tokens": n, "ids_crc32": pa.array([zlib.crc32(v) for v in views], pa.int64())}
                if include_ids:
                    out["ids"] = pa.array([v.tobytes() for v in views], pa.binary())
                yield pa.record_batch(out)

    manifest = spark.read.parquet(f"{path}/manifest")
    # one row for each shard file
    files = manifest.select("file", (F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens")).alias("base"))
    content = spark.read.format("binaryFile").load(f"{path}/data").where(F.col("path").endswith(".arrows"))
    found = content.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * include_ids)
    return found.join(files, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if include_ids else []))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
