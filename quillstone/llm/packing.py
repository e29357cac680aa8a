"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours that fill each seed's window.

Terms are token ids, so document frequencies over the whole corpus are at most one number for each
vocabulary entry, whatever the corpus' size. An index over the whole corpus, sharded by key, posts
every document under each pair of its strongest (highest-idf) terms; a document's neighbour is one
that shares its strongest pair with another document. Following these links a few steps gives
documents of one subject one label, and the order of labels is dealt into shards of a bounded number
of tokens; a hot source or group of copies simply spans several shards. Each shard is then indexed
whole, and seeds take their unused neighbours in the order of their BM25 scores with the corpus-wide
statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_groups, load, pieces, ragged, shared_dir
from .tokens import worker_tokenizer

WINDOW = 4096
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Strongest terms of a document, whose pairs it is posted under; rounds of following links, each doubling the steps.
STRONGEST, ROUNDS = 4, 2
#: Documents coded at once.
_TEXTS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _terms(ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, id) pairs of ragged rows, in order."""
    bits = int(ids.max(initial=0)).bit_length()
    kind = np.uint32 if (len(offs) - 1) << bits < 1 << 32 else np.uint64  # narrow numbers sort faster
    coded = np.repeat(np.arange(len(offs) - 1, dtype=kind) << kind(bits), np.diff(offs)) | ids.astype(kind)
    coded.sort()
    keep = np.ones(len(coded), bool)
    np.not_equal(coded[1:], coded[:-1], out=keep[1:])
    coded = coded[keep]
    return (coded >> kind(bits)).astype(np.int64), (coded & kind((1 << bits) - 1)).astype(np.int64)


def tokenised(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes doc_id, node, n_tokens and ids (little-endian uint16 if they fit) of all texts to `path` and reads them.

    A node is a hash of the ids, so equal texts are one node. Each task adds a row without a node
    whose ids are its documents' frequencies, one 64-bit number for each id, and whose doc_id and n_tokens are
    the numbers of its documents and tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer)
        total, rows, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                ids, offs = encoder.encode(some.column(1), end_id)
                seen = np.bincount(_terms(ids, offs)[1], minlength=len(total))
                seen[: len(total)] += total
                total, rows, size = seen, rows + some.num_rows, size + len(ids)
                raw = ids.astype("<u4").tobytes()
                own = [_narrow(raw[a:b]) for a, b in zip((4 * offs[:-1]).tolist(), (4 * offs[1:]).tolist(), strict=True)]
                node = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64).view(np.int64)
                yield pa.record_batch({"doc_id": some.column(0), "node": node, "n_tokens": np.diff(offs), "ids": pa.array(own, pa.binary())})
        yield pa.record_batch({"doc_id": pa.array([rows], pa.int64()), "node": pa.nulls(1, pa.int64()), "n_tokens": pa.array([size], pa.int64()), "ids": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(encode, "doc_id long, node long, n_tokens long, ids binary").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _narrow(raw: bytes) -> bytes:
    """uint16 if all ids fit; then the byte length is twice the number of tokens, else four times."""
    ids = np.frombuffer(raw, "<u4")
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else raw


def _ids(raw: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if memoryview(raw).nbytes == 2 * n else "<u4").astype(np.int64)


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Over all documents: in how many each token id occurs, the number of documents and of tokens."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for n, m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                more = np.frombuffer(raw.as_buffer(), "<i8").copy()
                small, total = (total, more) if len(more) > len(total) else (more, total)
                total[: len(small)] += small
                docs, size = docs + n, size + m
        some = np.flatnonzero(total)
        yield pa.record_batch({"term": np.concatenate([some, [-1, -2]]), "df": np.concatenate([total[some], [docs, size]])})

    rows = tokens.where("node IS NULL").select("doc_id", "n_tokens", "ids").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    got = {r["term"]: r["df"] for r in rows}  # at most one row for each entry of the vocabulary
    out = np.zeros(max(0, *got) + 1 if got else 1, np.int64)
    for k, v in got.items():
        if k >= 0:
            out[k] = v
    return out, got.get(-1, 0), got.get(-2, 0)


def _weights(idf: np.ndarray, tf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def strongest(ids: np.ndarray, offs: np.ndarray, strength: np.ndarray, most: int = STRONGEST) -> np.ndarray:
    """For each row its `most` distinct ids of the greatest strength (ties to the smaller id), -1 where there are fewer of any strength."""
    by = np.argsort(-strength, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    good = strength[ids] > 0
    row, at = _terms(place[ids[good]], np.concatenate([[0], np.cumsum(good)])[offs])  # of each row the strongest first
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(offs) - 1))[row]
    out = np.full((len(offs) - 1, most), -1, np.int32)
    top = rank < most
    out[row[top], rank[top]] = by[at[top]]
    return out


def labels(tokens: DataFrame, df: np.ndarray, idf: np.ndarray) -> DataFrame:
    """node, n (its copies), label, t0, t1, ...: of each distinct text the label of its subject and its strongest terms.

    A term that one document alone has, or more than half of all, leads nowhere. Every text is posted
    under all pairs of its strongest terms; it links to the smallest text (the smallest itself to the
    greatest) of the pair with the greatest idf that another text has too. Texts without such a pair
    are their own label. A posting list is only ever an aggregate, so a hot pair is no hot task.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(np.where(df > 1, idf, 0))  # a number for each entry of the vocabulary
    terms = [f"t{i}" for i in range(STRONGEST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                rows = [_ids(raw.as_buffer(), n) for raw, n in zip(some.column(2), some.column(1).to_pylist(), strict=True)]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
                top = strongest(np.concatenate(rows) if rows else np.zeros(0, np.int64), offs, shared.value)
                power = np.where(top >= 0, shared.value[top], -1e9).astype(np.float64)
                yield pa.record_batch({"node": some.column(0), **{t: top[:, i] for i, t in enumerate(terms)}, **{f"p{i}": power[:, i] for i in range(STRONGEST)}})

    schema = "node long, " + ", ".join(f"{t} int" for t in terms) + ", " + ", ".join(f"p{i} double" for i in range(STRONGEST))
    texts = tokens.where("node IS NOT NULL").select("node", "n_tokens", "ids").mapInArrow(run, schema)
    texts = checkpoint(texts.groupBy("node").agg(*[F.first(c).alias(c) for c in texts.columns if c != "node"], F.count("*").alias("copies")))
    pair = lambda i, j: F.struct(F.least(f"t{i}", f"t{j}").alias("a"), F.greatest(f"t{i}", f"t{j}").alias("b"), (F.col(f"p{i}") + F.col(f"p{j}")).alias("power"))
    posted = texts.select("node", F.explode(F.array(*[pair(i, j) for i, j in combinations(range(STRONGEST), 2)])).alias("key")).where("key.a >= 0").select("node", "key.*")
    lists = posted.groupBy("a", "b").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max("power").alias("power"), F.count("*").alias("n")).where("least < most")
    # a posting list's two ends come back to its texts by the pair; what travels is narrow
    total = texts.count()
    ends = join_groups(posted.select("node", "a", "b"), lists, ["a", "b"], total, "node").where("power IS NOT NULL")
    best = ends.groupBy("node").agg(F.max(F.struct("power", "a", "b", F.when(F.col("node") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("to"))).alias("best"))
    links = checkpoint(best.select("node", F.col("best.to").alias("to")))

    def follow(step: DataFrame, by: DataFrame) -> DataFrame:
        """node, to and where `by` leads from there: every link leads to a text with a link of its own, but many to the same one."""
        asked = step.groupBy("to").agg(F.count("*").alias("n")).join(by.select(F.col("node").alias("to"), F.col("to").alias("then")), "to")
        return join_groups(step, asked, ["to"], total, "node")

    step = links
    for _ in range(ROUNDS):
        step = checkpoint(follow(step, step).select("node", F.col("then").alias("to")))
    last = follow(step, links).select("node", F.least("to", "then").alias("label"))
    return texts.join(last, "node", "left").select("node", F.col("copies").alias("n"), F.coalesce("label", "node").alias("label"), *terms)


class _Bm25:
    """The inverted index of one shard."""

    def __init__(self, rows: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        lens = np.array([len(x) for x in rows])
        doc = np.repeat(np.arange(len(rows)), lens)
        width = len(idf)
        coded, tf = np.unique(doc * width + np.concatenate(rows), return_counts=True)
        doc, term = coded // width, coded % width
        good = idf[term] > 0  # terms in more than half of all documents weigh nothing
        doc, term, tf = doc[good], term[good], tf[good]
        weight = _weights(idf[term], tf, lens[doc], mean)
        self.n, self.term = len(rows), term
        self.at = np.searchsorted(doc, np.arange(len(rows) + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        count = np.bincount(term, minlength=width)
        self.first, self.count = np.cumsum(count) - count, count

    def scores(self, seed: int) -> np.ndarray:
        terms = self.term[self.at[seed] : self.at[seed + 1]]
        hits = ragged(self.first[terms], self.count[terms])
        return np.bincount(self.doc[hits], self.weight[hits], minlength=self.n)


def pack_shard(names: list, texts: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document number, start, length), each of `window` tokens but for the last ones, of powers of two.

    Whole windows of long documents stand alone. What remains of a document is a seed or a neighbour:
    the best-scored unused neighbours that fit go in whole, then the best one left is cut to fill the
    window to its last token and its rest stays in the index. What the shard has left at its end is cut
    into powers of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(texts), np.int64)
    left = np.array([len(x) for x in texts], np.int64)
    for d in range(len(texts)):
        while left[d] >= window:
            out.append([(d, int(start[d]), window)])
            start[d] += window
            left[d] -= window
    some = np.flatnonzero(left)
    if not len(some):
        return out
    index = _Bm25([texts[d][start[d] :] for d in some], idf, mean)
    unused = np.ones(len(some), bool)
    for seed in range(len(some)):
        if not unused[seed]:
            continue
        room, own = window, []

        def take(k: int) -> None:
            nonlocal room
            d = some[k]
            n = int(min(room, left[d]))
            own.append((int(d), int(start[d]), n))
            start[d] += n
            left[d] -= n
            room -= n
            unused[k] = left[d] > 0

        take(seed)
        if unused.any():
            order = np.argsort(-index.scores(seed), kind="stable")
            order = order[unused[order]]
            sizes, at = left[some[order]], 0
            while room and (fits := sizes[at:] <= room).any():  # every neighbour is tried whole, best first
                at += int(fits.argmax()) + 1
                take(order[at - 1])
            for k in order[unused[order]].tolist():
                if not room:
                    break
                take(k)
        if room == 0:
            out.append(own)
            continue
        total = window - room  # the shard's end
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                need, seq = 1 << bit, []
                while need:
                    d, s, n = own[0]
                    m = min(n, need)
                    seq.append((d, s, m))
                    need -= m
                    own = ([(d, s + m, n - m)] if n > m else []) + own[1:]
                out.append(seq)
    return out


def pack(docs: DataFrame, tokenizer: str, work: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, include_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    A null or empty text is a document of the end id alone. Repeated rows and ids are separate
    documents. An empty table gives no rows; other columns are ignored. Sequences have `window`
    tokens, or a smaller power of two. include_ids adds the piece's ids (uint32).
    """
    tokens = tokenised(docs, f"{work}/tokens", tokenizer, end_id)
    df, n, size = document_frequencies(tokens)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    mean = max(1.0, size / max(1, n))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # an entry of the vocabulary each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 36
        names, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            cols: list[list] = [[] for _ in range(8)]
            for seq in pack_shard(names, texts, shared.value, mean, window):
                at = 0
                for d, s, m in seq:
                    raw = texts[d][s : s + m].astype("<u4").tobytes()
                    for c, v in zip(cols, (names[d], s, m, zlib.crc32(raw), len(texts[d]), next_id, at, raw), strict=True):
                        c.append(v)
                    at += m
                next_id += 1
            out = {k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), cols, strict=False)}
            return pa.record_batch(out | ({"ids": pa.array(cols[7], pa.binary())} if include_ids else {}))

        for batch in batches:
            for name, n_ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names.append(name)
                texts.append(_ids(raw.as_buffer().to_pybytes(), n_ids))
                held += n_ids
                if held >= shard_tokens:
                    yield flush()
                    names, texts, held = [], [], 0
        if names:
            yield flush()

    found = checkpoint(labels(tokens, df, idf))
    # labels are dealt by their hash, so that long documents do not lie side by side
    by = [F.xxhash64("label"), F.col("label"), *[F.col(f"t{i}") for i in range(STRONGEST)], F.col("node"), F.col("doc_id")]
    placed = join_groups(tokens.where("node IS NOT NULL"), found, ["node"], n, "doc_id")
    dealt = placed.repartitionByRange(pieces(docs, 16 << 20), *by).sortWithinPartitions(*by)
    return dealt.select("doc_id", "n_tokens", "ids").mapInArrow(run, PIECES + ", ids binary" * include_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))
