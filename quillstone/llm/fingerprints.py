"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's lower-cased shingles, cut to 48 bits,
ascending, base64. Shingles are runs of five words and, so that short texts and those written without
spaces have some too, runs of eight characters inside words of over 24 bytes and of texts of fewer than five words.
Sketches of parts merge into the sketch of the whole; two sketches give resemblance and containment,
one gives the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, load, lower_ascii, mix, pieces, shingle_sets, slices, strings, word_spans

K = 128
#: Characters of a shingle inside a word, bytes beyond which a word has them, words below which a text has them.
CHARS, LONG_WORD, FEW_WORDS = 8, 24, 5
#: Partitions that rows are dealt to in order, at most; a partition is streamed, so its size does not bind memory.
PARTS = 1 << 15
BYTES = 6
_SPAN = 1 << (8 * BYTES)


def character_shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of CHARS characters inside long words and the words of texts of few words (shorter words: the whole word)."""
    values, rows, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for _, part in slices(col, 1 << 20):
        raw, offs = buffer_of(part)
        raw = lower_ascii(raw)
        starts, ends, first = word_spans(raw, offs)
        count = np.diff(first)
        row = np.repeat(np.arange(len(part)), count)
        some = np.flatnonzero((ends - starts > LONG_WORD) | (count < FEW_WORDS)[row])
        if len(some):
            begins = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
            code = np.add.reduceat(raw.astype(np.uint64) << (np.uint64(8) * (np.arange(len(raw)) - np.repeat(begins, np.diff(begins, append=len(raw)))).astype(np.uint64)), begins)
            a, b = np.searchsorted(begins, starts[some]), np.searchsorted(begins, ends[some])
            per = np.maximum(b - a - CHARS + 1, 1)
            at = np.repeat(a - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            end, value = np.repeat(b, per), np.full(int(per.sum()), CHARS, np.uint64)
            for k in range(CHARS):
                inside = at + k < end
                value[inside] = mix(value[inside] * np.uint64(0xD1342543DE82EF95) + code[at[inside] + k])
            values.append(value)
            rows.append(np.repeat(row[some], per) + base)
        base += len(part)
    return np.concatenate(values), np.concatenate(rows)


def sketches(col: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The bottom-k values of each text, ascending, and row offsets. Null, empty and blank texts have none."""
    texts = strings(col)
    values, offs = shingle_sets(texts)
    more, of = character_shingles(texts)
    if len(more):  # some rows have shingles of characters beside those of words
        row = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(offs)), of])
        values = np.concatenate([values, more])
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        values, offs = values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(texts)))])
    size = np.minimum(np.diff(offs), k)
    keep = np.arange(len(values)) - np.repeat(offs[:-1], np.diff(offs)) < k
    return (values[keep] >> np.uint64(64 - 8 * BYTES)), np.concatenate([[0], np.cumsum(size)])


def encoded(values: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()
    return [base64.b64encode(raw[a:b]).decode() for a, b in zip((BYTES * offs[:-1]).tolist(), (BYTES * offs[1:]).tolist(), strict=True)]


def decoded(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BYTES :] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64)


def merged(parts: list[str], k: int = K) -> str:
    """The sketch of the union of the sketched sets."""
    all_ = np.unique(np.concatenate([decoded(x) for x in parts] or [np.zeros(0, np.uint64)]))[:k]
    return encoded(all_, np.array([0, len(all_)]))[0]


def distinct_count(sketch: str, k: int = K) -> float:
    """Exact for sets smaller than k."""
    v = decoded(sketch)
    return float(len(v)) if len(v) < k else (k - 1) * _SPAN / float(int(v[-1]) + 1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int = K) -> np.ndarray:
    """Resemblance of row i of a to row i of b: the share of both among the k smallest of either; two empty ones are alike."""
    n = len(a[1]) - 1
    row = np.concatenate([np.repeat(np.arange(n), np.diff(a[1])), np.repeat(np.arange(n), np.diff(b[1]))])
    value = np.concatenate([a[0], b[0]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    both = np.zeros(len(row), bool)
    both[:-1] = ~first[1:]
    at = np.cumsum(first)
    per = np.bincount(row[first], minlength=n)
    rank = at - np.concatenate([[0], np.cumsum(per)])[row]  # from 1, in the row's distinct values
    use = first & (rank <= k)
    union = np.bincount(row[use], minlength=n)
    shared = np.bincount(row[use & both], minlength=n)
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def resemblance(a: str, b: str, k: int = K) -> float:
    x, y = decoded(a), decoded(b)
    return float(likeness((x, np.array([0, len(x)])), (y, np.array([0, len(y)])), k)[0])


def containment(a: str, b: str, k: int = K) -> float:
    """The estimated share of a's shingles that b has; an empty a is contained in everything."""
    n = distinct_count(a, k)
    r = resemblance(a, b, k)
    return 1.0 if n == 0 else min(1.0, r / (1 + r) * (n + distinct_count(b, k)) / n)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.record_batch({"doc_id": some.column(0), "fingerprint": encoded(*sketches(some.column(1), k))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def merge_by(parts: DataFrame, *by: str, k: int = K) -> DataFrame:
    """by..., fingerprint: the merged sketch of each group; a task merges what it reads of a group before the shuffle."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1][list(by)].copy()
        held = ""
        for at in range(0, len(pdf), 1000):
            held = merged([held, *pdf["fingerprint"].iloc[at : at + 1000].dropna()], k)
        one["fingerprint"] = held
        return one

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in by) + ", fingerprint string"

    def early(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([merge(g) for _, g in pdf.groupby(list(by), dropna=False, sort=False)]) if len(pdf) else pdf[[*by, "fingerprint"]]

    partial = parts.select(*by, "fingerprint").mapInPandas(early, schema)
    salted = partial.withColumn("__salt", F.spark_partition_id() % 32)
    half = salted.groupBy(*by, "__salt").applyInPandas(lambda pdf: merge(pdf), schema)
    return half.groupBy(*by).applyInPandas(merge, schema)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in ascending id order over partitions, each followed by the first row of the next partition (ahead = 1); the last by the very first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # bounds are ids of rows, so the row at a bound is the first of its partition: every so-and-so-many-th
    # of a sample by hash of the ids, which has about 16 for each of at most PARTS partitions
    parts = min(PARTS, pieces(docs, 4 << 20))
    told = rows.agg(F.count("*").alias("n"), F.min("key").alias("first")).first()
    every, first = max(1, told["n"] // (16 * parts)), told["first"]
    held = rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").distinct().toArrow()["key"].to_numpy()
    some = np.sort(held)[:: max(1, len(held) // parts)] if len(held) else np.zeros(0, np.int64)
    bounds = some[some > first].astype(np.int64) if len(some) else some.astype(np.int64)
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        k = key.to_numpy()
        at = np.searchsorted(bounds, k, "right")
        edge = (k == first) | (at > 0) & (bounds[np.maximum(at - 1, 0)] == k) if last else k == first
        return pd.Series([[a, (a - 1) if a else last] if e else [a] for a, e in zip(at.tolist(), edge.tolist(), strict=True)])

    spread = rows.select("doc_id", "text", "key", F.posexplode(parts_of("key")).alias("ahead", "part"))
    return spread.repartitionById(last + 1, F.col("part")).sortWithinPartitions("ahead", "key", "text"), last + 1


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The order is doc_id, then text, null ids first; the last row's next is the first. Null texts count
    as empty. Two texts without shingles are alike (1.0), one without and one with are not (0.0).
    Repeated rows and ids are rows of their own, an empty table gives none, other columns are ignored.
    A task streams its rows and holds some thousand texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row whose next has not come yet
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                rows = [held] * (held is not None) + list(zip(*(c.to_pylist() for c in some.columns), strict=True))
                held = rows[-1]
                own = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
                if not own:
                    continue
                texts, nexts = [a[1] for a, _ in own], [b[1] for _, b in own]
                edits = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts, strict=True)]
                mine = sketches(pa.array([*texts, nexts[-1]], pa.string()), k)
                cut = mine[1][-2]
                a, b = (mine[0][:cut], mine[1][:-1]), (mine[0][mine[1][1] :], mine[1][1:] - mine[1][1])
                new = sketches(pa.array(edits, pa.string()), k)
                yield pa.record_batch({"doc_id": pa.array([x[0] for x, _ in own], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edits], "fingerprint": encoded(*a), "edited_fingerprint": encoded(*new), "near_edited": likeness(a, new, k), "near_next": likeness(a, b, k)})

    rows, _ = with_next(docs)
    return rows.select("doc_id", "text", "ahead").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(load(spark, sf_dir, "documents"))
