"""Substring dedup with fixed-block anchors.

Every document's non-overlapping blocks of `window` // 2 words are indexed and probed with every
rolling window of that length: a run of `window` equal words in two documents always holds a whole
indexed block of one of them. Around the hits the windows of `window` words meet by 64-bit hashes and
learn the smallest document that has them; adjoining windows of one such source make a hit extended
as far as it goes. These maximal runs go to their source, whose words are compared with theirs, and only what
is equal word by word is a repeat.

Texts are dealt once, by hash of the id, into chunks of bounded size. What chunks exchange are packed
arrays: for each chunk and bucket 32-bit block hashes one way and one bit per hash back (is the
block in another chunk?), then 64-bit hashes of the windows near hits with their first document, and
the sources of those that an earlier document has; at last the words of each run once for each chunk and source, and bits
back. The order of hashes follows from the texts, so no positions travel, nothing is expanded into
pairs, and a passage shared by a third of all documents is spread over all buckets like any other words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, load, pieces, shared_dir, slices, strings, window_hashes, word_hashes, word_spans

#: Words of a window; copies of each answer about a run.
WINDOW, SALTS = 50, 8
_FIRST = -(1 << 63)


class _Chunk:
    """The words of one chunk's documents, in (doc_id, text) order, without those of documents shorter than a window."""

    def __init__(self, table: pa.Table, window: int, buckets: int, hashed: bool = True) -> None:
        table = table.combine_chunks()
        self.texts = strings(table["text"])
        ids = table["doc_id"].combine_chunks().fill_null(_FIRST).to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            as_text = self.texts.to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], as_text[i])))
        self.texts, self.ids, self.order = self.texts.take(pa.array(order)), ids[order], order
        self.null = table["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)[order]
        self.window, self.block, self.buckets = window, window // 2, buckets
        hashes, counts = [], []
        for _, part in slices(self.texts, 1 << 20):
            raw, offs = buffer_of(part)
            starts, ends, first = word_spans(raw, offs)
            hashes.append(word_hashes(raw, starts, ends) if hashed else np.zeros(0, np.uint64))
            counts.append(np.diff(first))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.used = np.flatnonzero(self.counts >= window)
        self.words = words[np.repeat(self.counts >= window, self.counts)] if hashed else words
        self.size = self.counts[self.used]
        self.total = int(self.size.sum())
        self.first = np.cumsum(self.size) - self.size

    def _places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n words begin that do not leave their document, and the number of that document."""
        doc = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(self.words))
        inside = at + n <= (self.first + self.size)[doc]
        return at[inside], doc[inside]

    def _bucket(self, values: np.ndarray) -> np.ndarray:
        return ((values >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 1 << 16 else np.uint32)

    def probes(self):
        """Hashes of the rolling and of the indexed blocks, their places, and the order by bucket in which they are sent."""
        at, doc = self._places(self.block)
        value = window_hashes(self.words, self.block)[at] if len(at) else np.zeros(0, np.uint64)
        fixed = np.flatnonzero((at - self.first[doc]) % self.block == 0)
        bucket = self._bucket(value)
        return at, doc, value, fixed, bucket

    def near(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows around hits: their places, documents and hashes."""
        at, doc, value, fixed, bucket = self.probes()
        order, fixed_order = np.argsort(bucket, kind="stable"), np.argsort(bucket[fixed], kind="stable")
        mark = np.zeros(len(self.words) + 1, bool)
        mark[at[order]] = _bits(replies, "probes", bucket[order])
        mark[at[fixed[fixed_order]]] |= _bits(replies, "blocks", bucket[fixed][fixed_order])
        # hits among the chunk's own documents
        if len(fixed):
            by = np.argsort(value[fixed], kind="stable")
            keys, start = np.unique(value[fixed][by], return_index=True)
            low, high = np.minimum.reduceat(doc[fixed][by], start), np.maximum.reduceat(doc[fixed][by], start)
            k = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            known = keys[k] == value
            other = known & ((low[k] != doc) | (high[k] != doc))
            mark[at[other]] = True
            hot_low, hot_high = np.full(len(keys), len(self.size)), np.full(len(keys), -1)
            np.minimum.at(hot_low, k[known], doc[known])
            np.maximum.at(hot_high, k[known], doc[known])
            own = k[fixed]
            mark[at[fixed[(hot_low[own] != doc[fixed]) | (hot_high[own] != doc[fixed])]]] = True
        seen = np.concatenate([[0], np.cumsum(mark)])
        places, docs = self._places(self.window)
        some = seen[places + self.window - self.block + 1] > seen[places]
        places, docs = places[some], docs[some]
        values = window_hashes(self.words, self.window)[places] if len(places) else np.zeros(0, np.uint64)
        return places, docs, values

    def first_of(self, docs: np.ndarray, values: np.ndarray):
        """Of each distinct hash, in order of bucket and value, its first document's id; and for each window the number of its hash."""
        keys, inverse = np.unique(values, return_inverse=True)
        first = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, self.ids[self.used[docs]])
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        return keys, first, inverse, bucket, order


def _bits(replies: pa.Table, name: str, bucket: np.ndarray) -> np.ndarray:
    """The replies' bits for values in these (sorted) buckets; buckets without a reply have none set."""
    got = dict(zip(replies["bucket"].to_pylist(), replies[name], strict=True)) if replies.num_rows else {}
    out = np.zeros(len(bucket), bool)
    for b, at, to in _parts(bucket):
        if (raw := got.get(b)) is not None and raw.is_valid:
            out[at:to] = np.unpackbits(np.frombuffer(raw.as_buffer(), np.uint8), count=to - at)
    return out


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, start and end of each bucket that occurs in the sorted array."""
    own, start = np.unique(bucket, return_index=True)
    return list(zip(own.tolist(), start.tolist(), np.append(start[1:], len(bucket)).tolist()[: len(own)], strict=True))


def _cut(values: np.ndarray, parts: list[tuple[int, int, int]]) -> list[bytes]:
    """The bytes of the values of each part."""
    raw, size = values.tobytes(), values.itemsize
    return [raw[a * size : b * size] for _, a, b in parts]


def messages(chunk: int, parts: list[tuple[int, int, int]], **columns: list[bytes]) -> pa.Table:
    """A row for each bucket that a chunk has something for, and only for those."""
    return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int64()), "bucket": pa.array([b for b, _, _ in parts], pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in columns.items()}})


def _groups(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, each one's chunk, and the number from each row."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    size = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(table["chunk"].to_numpy(), size), size


def _packed_bits(flags: np.ndarray, size: np.ndarray) -> list[bytes]:
    ends = np.cumsum(size)
    return [np.packbits(flags[a:b]).tobytes() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


_KINDS = {"probes": pa.binary(), "blocks": pa.binary(), "windows": pa.binary(), "names": pa.binary(), "firsts": pa.binary()}
#: What a run is known by: its source and 128 bits of its words.
_RUN = ["source", "k1", "k2"]
_REPLY = "chunk long, bucket long, " + ", ".join(f"{k} binary" for k in _KINDS)


def _reply(chunk: pa.Array, bucket: pa.Array, **columns: list[bytes]) -> pa.Table:
    return pa.table({"chunk": chunk, "bucket": bucket, **{k: pa.array(columns[k], t) if k in columns else pa.nulls(len(chunk), t) for k, t in _KINDS.items()}})


def match_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket of block hashes: which occur in another chunk, as a block or under a probe."""
    probe, probe_chunk, probe_size = _groups(table, "probes", "<u4")
    block, block_chunk, block_size = _groups(table, "blocks", "<u4")
    hit, hot = np.zeros(len(probe), bool), np.zeros(len(block), bool)
    if len(block):
        order = np.argsort(block, kind="stable")
        keys, start = np.unique(block[order], return_index=True)
        low, high = np.minimum.reduceat(block_chunk[order], start), np.maximum.reduceat(block_chunk[order], start)
        k = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        known = np.flatnonzero(keys[k] == probe)
        k, own = k[known], probe_chunk[known]
        hit[known] = (low[k] != own) | (high[k] != own)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        np.minimum.at(least, k, own)
        np.maximum.at(most, k, own)
        b = np.searchsorted(keys, block)
        hot = (least[b] != block_chunk) | (most[b] != block_chunk)
    return _reply(table["chunk"], table["bucket"], probes=_packed_bits(hit, probe_size), blocks=_packed_bits(hot, block_size))


def match_windows(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket of window hashes: which have an earlier document in another chunk, and the first such document."""
    value, _, size = _groups(table, "windows", "<u8")
    ids = np.concatenate([np.frombuffer(names.as_buffer(), "<i8")[np.frombuffer(index.as_buffer(), "<u4")] for names, index in zip(table["names"], table["firsts"], strict=True)])
    keys, inverse = np.unique(value, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids)
    least = least[inverse]
    earlier, ends = least < ids, np.cumsum(size)
    names, firsts = [], []
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        own, index = np.unique(least[a:b][earlier[a:b]], return_inverse=True)
        names.append(own.astype("<i8").tobytes())
        firsts.append(index.astype("<u4").tobytes())
    return _reply(table["chunk"], table["bucket"], windows=_packed_bits(earlier, size), names=names, firsts=firsts)


class _Repeats:
    """The windows of a chunk that an earlier document's hash has, as maximal runs of adjoining windows of one source."""

    def __init__(self, chunk: _Chunk, replies: pa.Table) -> None:
        self.chunk = chunk
        second = replies.filter(replies["windows"].is_valid())
        places, docs, values = chunk.near(replies.filter(replies["probes"].is_valid()))
        keys, source, inverse, bucket, order = chunk.first_of(docs, values)
        earlier = _bits(second, "windows", bucket[order])
        told = {b: np.frombuffer(n.as_buffer(), "<i8")[np.frombuffer(i.as_buffer(), "<u4")] for b, n, i in zip(second["bucket"].to_pylist(), second["names"], second["firsts"], strict=True)}
        for b, at, to in _parts(bucket[order]):
            if b in told:
                source[order[at:to][earlier[at:to]]] = told[b]
        source = source[inverse]
        gone = source < chunk.ids[chunk.used[docs]]
        self.places, self.docs, self.source = places[gone], docs[gone], source[gone]
        cut = (np.diff(self.docs) != 0) | (np.diff(self.source) != 0) | (np.diff(self.places) != 1)
        self.first = np.concatenate([[0], np.flatnonzero(cut) + 1]).astype(np.int64) if len(self.places) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(self.places)))
        held: dict[tuple[int, bytes], int] = {}
        self.claim, doc, words = np.zeros(len(self.first), np.int64), -1, []
        for i, (a, n) in enumerate(zip(self.first.tolist(), self.size.tolist(), strict=True)):
            if self.docs[a] != doc:
                doc = self.docs[a]
                words = chunk.texts[int(chunk.used[doc])].as_buffer().to_pybytes().split()
            at = int(self.places[a] - chunk.first[doc])
            self.claim[i] = held.setdefault((int(self.source[a]), b" ".join(words[at : at + n + chunk.window - 1])), len(held))
        self.claims = list(held)

    def packed(self) -> bytes:
        """The first window, the number of windows and the claim of every run."""
        return np.stack([self.places[self.first], self.size, self.claim], 1).astype("<i8").tobytes()


def equal_windows(runs: np.ndarray, bits: dict[int, pa.Scalar]) -> np.ndarray:
    """Places of the windows of these runs (first, windows, claim) whose words are those of their source."""
    out = [np.zeros(0, np.int64)]
    for a, n, c in runs.tolist():
        raw = np.frombuffer(bits[c].as_buffer(), np.uint8)
        out.append(a + (np.flatnonzero(np.unpackbits(raw, count=n)) if len(raw) else np.arange(n)))
    return np.concatenate(out)


def compare(table: pa.Table, asked: pa.Table, window: int) -> pa.Table:
    """For each run (words joined by blanks) that is said to be in a document of this chunk: no bytes if all of it is, else a bit for each window."""
    texts = strings(table["text"])
    place: dict[int, list[int]] = {}
    for i, x in enumerate(table["doc_id"].combine_chunks().fill_null(_FIRST).to_pylist()):
        place.setdefault(x, []).append(i)
    held: tuple[int | None, bytes] = (None, b"")
    out = []
    asked = asked.sort_by("source")
    for source, raw in zip(asked["source"].to_pylist(), asked["words"], strict=True):
        if held[0] != source:  # a line break is no word, so no run goes from one text of an id to the next
            held = source, b" \n ".join(b" " + b" ".join(texts[i].as_buffer().to_pybytes().split()) + b" " for i in place.get(source, []))
        whole = raw.as_buffer().to_pybytes()
        if b" " + whole + b" " in held[1]:
            out.append(b"")
            continue
        words = whole.split(b" ")
        out.append(np.packbits([b" " + b" ".join(words[i : i + window]) + b" " in held[1] for i in range(len(words) - window + 1)]).tobytes())
    return asked.select(_RUN).append_column("equal", pa.array(out, pa.binary()))


def dedup(docs: DataFrame, window: int = WINDOW, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), repeats (spans of removed words: start, end).

    A word goes if a run of `window` words of its document that covers it also begins in a document
    with a smaller doc_id, judged on the input. A null id counts as the smallest; rows of one id never
    remove each other's words. Null, empty and blank texts have no words; texts under `window` words
    stay whole. An empty table gives no rows; other columns are ignored, but for those named in carry,
    which come back as they were in a struct, row. Memory of a task follows the chunk and its longest text.
    """
    parts = pieces(docs, 4 << 20)
    buckets = parts
    held = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(h) for c, h in zip(carry, held, strict=True)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition(parts, "chunk")

    def send_blocks(key: tuple, table: pa.Table) -> pa.Table:
        _, _, value, fixed, bucket = _Chunk(table, window, buckets).probes()
        low = value.astype("<u4")
        a = np.argsort(bucket, kind="stable")
        b = fixed[np.argsort(bucket[fixed], kind="stable")]
        parts_ = _parts(bucket[a])
        blocks = dict(zip((x for x, _, _ in _parts(bucket[b])), _cut(low[b], _parts(bucket[b])), strict=True))
        return messages(key[0].as_py(), parts_, probes=_cut(low[a], parts_), blocks=[blocks.get(x, b"") for x, _, _ in parts_])

    def send_windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets)
        _, docs_, values = chunk.near(replies)
        keys, first, _, bucket, order = chunk.first_of(docs_, values)
        names, firsts, parts_ = [], [], _parts(bucket[order])
        for _, a, b in parts_:
            own, index = np.unique(first[order[a:b]], return_inverse=True)
            names.append(own.astype("<i8").tobytes())
            firsts.append(index.astype("<u4").tobytes())
        return messages(key[0].as_py(), parts_, windows=_cut(keys[order], parts_), names=names, firsts=firsts)

    def claim(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets)
        found = _Repeats(chunk, replies)
        n = len(found.claims)  # the last row has the runs themselves, which stay with the chunk
        return pa.table({"chunk": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "claim": pa.array([*range(n), -1], pa.int64()), "source": pa.array([*(x for x, _ in found.claims), 0], pa.int64()), "words": pa.array([*(w for _, w in found.claims), found.packed()], pa.binary())})

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets, hashed=False)
        told = dict(zip(replies["claim"].to_pylist(), replies["words"], strict=True))
        gone = equal_windows(np.frombuffer(told.pop(-1).as_buffer(), "<i8").reshape(-1, 3), told)
        steps = np.zeros(chunk.total + window + 1, np.int32)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + window, -1)
        cover = np.cumsum(steps)[: chunk.total] > 0
        removed = np.zeros(len(chunk.counts), np.int64)
        removed[chunk.used] = np.add.reduceat(cover, chunk.first) if len(chunk.used) else 0
        place = np.zeros(len(chunk.counts), np.int64)
        place[chunk.used] = chunk.first
        kept, spans = [], []
        for i, text in enumerate(chunk.texts):
            words = text.as_buffer().to_pybytes().split()
            if removed[i]:
                mask = cover[place[i] : place[i] + len(words)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                words = [words[j] for j in np.flatnonzero(~mask).tolist()]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({**{h: table[h].take(pa.array(chunk.order)) for h in held}, "doc_id": pa.array(chunk.ids, mask=chunk.null), "n_words": chunk.counts, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string()), "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    sent = dealt.groupBy("chunk").applyInArrow(send_blocks, "chunk long, bucket long, probes binary, blocks binary")
    hits = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match_blocks, _REPLY)
    sent = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, "chunk long, bucket long, windows binary, names binary, firsts binary")
    replies = hits.unionByName(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match_windows, _REPLY))
    asked = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(claim, "chunk long, claim long, source long, words binary")
    path = f"{shared_dir(docs.sparkSession)}/runs"
    asked.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), "words")}).write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    asked = kept.where("claim >= 0")
    # a run that many chunks have of one source is compared once
    once = asked.groupBy(*_RUN).agg(F.first("words").alias("words")).withColumn("to", F.pmod(F.xxhash64(F.when(F.col("source") != _FIRST, F.col("source"))), F.lit(parts)))
    compared = dealt.groupBy("chunk").cogroup(once.groupBy("to")).applyInArrow(lambda key, table, rows: compare(table, rows, window), "source long, k1 long, k2 long, equal binary")
    # copies of the answers keep a run that every chunk asks for from being one task's
    salted = compared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = asked.select("chunk", "claim", *_RUN, F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, [*_RUN, "salt"])
    told = told.select("chunk", "claim", F.col("equal").alias("words")).unionByName(kept.where("claim < 0").select("chunk", "claim", "words"))
    schema = "".join(f"{h} {rows.schema[h].dataType.simpleString()}, " for h in held) + "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: long, end: long>>"
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, schema)
    row = F.struct(*(F.col(h).alias(c) for c, h in zip(carry, held, strict=True))).alias("row")
    return out.select("doc_id", "n_words", "n_removed", "kept", "repeats", *([row] if carry else []))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN first ON win.h = first.h WHERE f < win.doc_id),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS txt, count(*) AS n FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
