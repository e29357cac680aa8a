"""Helpers shared by the training-data operators: shared folders, partition counts, vectorised word hashing."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and their negation as a Java/RE2 pattern.
SPACE = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_U = np.uint64
_M = _U(0xD1342543DE82EF95)
_M_INV = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Words beyond this many bytes are hashed one by one.
_LONG = 64
_SLICE = 1 << 20
#: A group with more than this part of all rows is hot; there are at most as many hot groups.
HOT = 1000
#: Files that a small table is kept in: so many a core, more only where its source has more stored bytes than so many times FILE_BYTES.
FILES, FILE_BYTES = 2, 64 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _base_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one, but only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder; what is in it goes when the session's JVM ends."""
    out = f"{_base_dir(spark).rstrip('/')}/quillstone-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def remove_dir(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cuts the lineage into the shared folder, which outlives lost executors; into at most `files` files, if given."""
    _base_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)


def few_files(df: DataFrame) -> int:
    """How many files are enough for df, or for what is made of it. On a local disk Hadoop has an executor start two processes (chmod) for each one."""
    return max(FILES * df.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(df) / FILE_BYTES))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, spread: str, alone: Column | None = None) -> DataFrame:
    """Left join of rows to groups (keys, n: the group's rows, and more columns), whatever share of all rows a group has.

    At most HOT groups have over total / HOT rows; those are broadcast, and their rows go on by the
    column `spread`, as those do that `alone` says have no group. The other groups meet their rows by the keys.
    """
    more = [c for c in groups.columns if c not in (*keys, "n")]
    hot = groups.where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in more))
    rest = groups.where(F.col("n") * HOT <= total).select(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__salt"), *more)  # 0, but no literal, or it would not be a join key
    known = rows.join(F.broadcast(hot), keys, "left")
    if alone is not None:
        known = known.withColumns({c: F.when(~alone, F.col(c)) for c in hot.columns if c not in keys})
    known = known.withColumn("__salt", F.when(F.col("__hot") if alone is None else F.col("__hot") | alone, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    found = known.join(rest, [*keys, "__salt"], "left")
    return found.select(*rows.columns, *(F.coalesce(f"__hot_{c}", c).alias(c) for c in more))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def make_dir(uri: str) -> str:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of the relation; 0 if it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 if size >= 1 << 60 else size


def pieces(df: DataFrame, each: int = 8 << 20) -> int:
    """How many partitions of about `each` stored bytes a table makes, at least the session's own number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(input_bytes(df) / each))


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return pc.fill_null(col, "")


def slices(col: pa.Array, most: int = 8 << 20):
    """(first, array) parts of a string array, each of about `most` bytes or one row."""
    n = len(col)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    at, base = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, col.slice(at, to - at)
        base, at = int(ends[to - 1]), to


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets into them."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = z ^ (z >> _U(30))
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


class _Powers:
    """Powers of the multiplier of long windows, and of its inverse."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, _SLICE + (1 << 10))
            a, b = np.full(self.n, _M), np.full(self.n, _M_INV)
            a[0] = b[0] = 1
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and for each row the number of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time through a bijective mixer; words of up to eight bytes and one length never collide.

    Every eight bytes are mixed before the next are added, so no sums of powers can cancel. Words of
    over 64 bytes have their xxh3 instead.
    """
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    keep = ~_U(0) >> (_U(64) - _U(8) * np.arange(9, dtype=np.uint64))
    keep[0] = 0
    out = mix((eight[starts] & keep[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _M + _U(seed)))
    some = np.flatnonzero(lens > 8)
    at = 8
    while len(some):
        left = lens[some] - at
        out[some] = mix(out[some] * _M + mix((eight[starts[some] + at] & keep[np.minimum(left, 8)]) ^ _U(at)))
        at += 8
        some = some[(left > 8) & (lens[some] <= _LONG)]
    for i in np.flatnonzero(lens > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; run i starts at word i."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = words[:count] * _M + _U(n)
        for i in range(1, n):
            out += words[i : i + count]
            out *= _M
        return mix(out)
    out = np.empty(count, np.uint64)
    for at in range(0, count, _SLICE):
        part = words[at : min(at + _SLICE, count) + n - 1]
        up, down = _POWERS.get(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        m = len(part) - n + 1
        out[at : at + m] = (sums[n:] - sums[:m]) * down[:m]
    return mix(out ^ _U(n))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def shingle_sets(col: pa.Array, n: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, ascending, and the row offsets.

    A text of 1 to n-1 words has one shingle, its whole word sequence; one without words has none.
    """
    values, offsets = [], [np.zeros(1, np.int64)]
    base = 0
    for _, part in slices(col):
        raw, offs = buffer_of(part)
        raw = lower_ascii(raw) if lower else raw
        starts, ends, first = word_spans(raw, offs)
        h = word_hashes(raw, starts, ends)
        counts = np.diff(first)
        runs = window_hashes(h, n)
        per = np.where(counts >= n, counts - n + 1, 0)
        rows = np.arange(len(counts))
        got, row = runs[ragged(first[:-1], per)] if len(runs) else np.zeros(0, np.uint64), np.repeat(rows, per)
        for k in range(1, n):  # short texts, by their number of words
            some = np.flatnonzero(counts == k)
            if len(some):
                one = h[first[some]] * _M + _U(k)
                for i in range(1, k):
                    one += h[first[some] + i]
                    one *= _M
                got, row = np.concatenate([got, mix(one)]), np.concatenate([row, some])
        if (row[1:] < row[:-1]).any():  # short texts came last
            order = np.argsort(row, kind="stable")
            got, row = got[order], row[order]
        ends = np.cumsum(np.bincount(row, minlength=len(counts)))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):  # each text by itself, which sorting both columns at once is far from
            got[a:b].sort()
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
        got, row = got[keep], row[keep]
        values.append(got)
        offsets.append(base + np.cumsum(np.bincount(row, minlength=len(counts))))
        base += len(got)
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.concatenate(offsets)
