"""Exact top-k inner products with vector-approximation files.

Equal vectors are one entry with their k + 1 smallest ids, so copies cost nothing. Components are cut
into uniform cells, one byte each, and the cells lie in packed blocks without the vectors. Each block
meets all queries, which its task reads from a table in the shared folder: the cells give a lower and
an upper bound of every score. The k-th best lower bound over all blocks says which entries can still
be among a query's best; of those alone the exact vectors are fetched, by key, and read in the order
of their bounds until the k-th best score is certain. What is shuffled grows with the vectors and the
queries, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_groups, load, open_fs, pieces, shared_dir

CELLS = 256
BLOCK = 1 << 16
QUERIES = 128
_KEY = ["dim", "h1", "h2"]
_QUERY = ["qid", "qh1", "qh2", "dim"]


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component, x as double, as a long (the ends of a long for what is beyond)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by))


def usable(vector: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, ok), F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of at most `most` rows of one number of components, which is the column dim."""
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            for at in range(0, some.num_rows, most):
                yield dim, some.slice(at, most)


def cell_edges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each number of components: the least and greatest value of every component (a row for each)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, some in _batches(batches, BLOCK):
            m = _matrix(some["v"], dim)
            lo, hi = m.min(0), m.max(0)
            if dim in seen:
                lo, hi = np.minimum(lo, seen[dim][0]), np.maximum(hi, seen[dim][1])
            seen[dim] = lo, hi
        for dim, (lo, hi) in seen.items():
            yield pa.record_batch({"dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    found = vectors.select("dim", "v").mapInArrow(ends, "dim int, at int, lo long, hi long").groupBy("dim", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "at").collect()
    out: dict[int, tuple[list, list]] = {}
    for r in found:
        lo, hi = out.setdefault(r["dim"], ([], []))
        lo.append(r["lo"])
        hi.append(r["hi"])
    return {0: (np.zeros(0), np.zeros(0))} | {k: (np.array(lo, float), np.array(hi, float)) for k, (lo, hi) in out.items()}


def cells_of(m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    wide = np.maximum(1e-9, (hi - lo) / CELLS)
    return np.clip(np.floor((m - lo) / wide), 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middle of each score's bounds, queries by entries, and for each query how far they lie from it.

    Each component is within a cell of its cell's middle (one, for the rounding at the edges), and the
    sum in doubles within its rounding error.
    """
    wide = np.maximum(1e-9, (hi - lo) / CELLS)
    q = queries.astype(float)
    middle = (q * wide) @ (cells.astype(np.float32).T + 0.5) + (q @ lo)[:, None]
    most = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi) + wide)
    return middle, np.abs(q) @ (wide * (0.5 + 1e-6)) + most * (q.shape[1] + 8) * 2.0**-50 + 1e-6


def exact_scores(q: np.ndarray, m: np.ndarray) -> list[int]:
    """Integer inner products of q with the rows of m; Python's integers where a long may overflow."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(m.astype(float)).max(initial=0)) * max(1, len(q))
    return (m @ q).tolist() if most < 2.0**62 else (m.astype(object) @ q.astype(object)).tolist()


def best_of(qid: int, q: np.ndarray, m: np.ndarray, upper: np.ndarray, ids: list, counts: list, k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best entries, read in the order of their upper bounds until the k-th is certain; ties to the smaller id."""
    order = np.argsort(-upper, kind="stable")
    best: list[tuple[int, int]] = []
    step = max(4 * k, 32)
    for at in range(0, len(order), step):
        part = order[at : at + step]
        if len(best) == k and upper[part[0]] < -best[-1][0]:
            break
        for i, score in zip(part.tolist(), exact_scores(q, m[part]), strict=True):
            best += [(-score, j) for j, n in zip(ids[i], counts[i], strict=True) if j != qid for _ in range(min(n, k))]
        best = sorted(best)[:k]
    return [(-s, j) for s, j in best]


def entries(rows: DataFrame, k: int) -> DataFrame:
    """dim, h1, h2, v, ids, counts: the distinct vectors with their k + 1 smallest ids and how often each id has them."""
    narrow = rows.groupBy(*_KEY, "vec_id").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*_KEY).orderBy("vec_id"))
    kept = narrow.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    lists = kept.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("of"))
    vectors = rows.groupBy(*_KEY).agg(F.first("v").alias("v"))
    return vectors.join(lists, _KEY).select(*_KEY, "v", F.col("of.vec_id").alias("ids"), F.col("of.n").alias("counts"))


def _pack(edges: dict, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, some in _batches(batches, block):
            lists = some["ids"]
            size = np.diff(lists.offsets.to_numpy())
            first = lists.flatten().to_numpy()[np.cumsum(size) - size]
            # an entry of one id alone is no candidate of that id
            out = {"dim": pa.array([dim], pa.int32()), "n": pa.array([some.num_rows], pa.int32())}
            for name, values in (("h1", some["h1"].to_numpy()), ("h2", some["h2"].to_numpy()), ("first", first), ("single", (size == 1).astype("<i8")), ("cells", cells_of(_matrix(some["v"], dim), *edges[dim]))):
                out[name] = pa.array([np.ascontiguousarray(values if values.dtype == np.uint8 else values.astype("<i8")).tobytes()], pa.binary())
            yield pa.record_batch(out)

    return run


def _scan(edges: dict, asked: str, k: int, step: int):
    """Bounds of a block's entries that can be among the k best of the block, for all queries of the table at `asked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch["dim"][i].as_py()
                raw = lambda name, kind: np.frombuffer(batch[name][i].as_buffer(), kind)  # noqa: B023, E731
                h1, h2, first, single = raw("h1", "<i8"), raw("h2", "<i8"), raw("first", "<i8"), raw("single", "<i8") > 0
                cells = raw("cells", np.uint8).reshape(len(h1), dim)
                by_id = np.argsort(first, kind="stable")[: k + 1]
                fs, path = open_fs(asked)
                for part in pads.dataset(path, filesystem=fs, format="parquet").to_batches(filter=pads.field("dim") == dim, batch_size=step):
                    if not part.num_rows:
                        continue
                    qid, q = part["qid"].to_numpy(), _matrix(part["qv"], dim)
                    middle, slack = bounds(q, cells, *edges[dim])
                    out: list[list[np.ndarray]] = []
                    for j in range(part.num_rows):
                        own = single & (first == qid[j])
                        upper = np.where(own, -np.inf, middle[j] + slack[j])
                        if not q[j].any():  # every score is 0, so the smallest ids are best
                            some = by_id[~own[by_id]][:k]
                        else:
                            least = np.partition(upper, -k)[-k] - 2 * slack[j] if len(upper) > k else -np.inf
                            some = np.flatnonzero((upper >= least) & (upper > -np.inf))
                        out.append([np.full(len(some), j), h1[some], h2[some], upper[some], upper[some] - 2 * slack[j]])
                    who, a, b, upper, lower = (np.concatenate(x) for x in zip(*out, strict=True))
                    asks = part.take(pa.array(who))
                    yield pa.record_batch({"qid": asks["qid"], "qh1": asks["qh1"], "qh2": asks["qh2"], "dim": pa.array(np.full(len(who), dim), pa.int32()), "h1": a, "h2": b, "upper": upper, "lower": lower})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k highest scores among all other vectors of as many components.

    vectors has vec_id and embedding. Null vectors, and those with a null id or a null or non-finite
    component, take no part. Vectors without components score 0 with each other. Ties go to the smaller vec_id; rows with the query's own vec_id are
    never its candidates; a repeated row is a candidate as often as it is there, a repeated query is one query (a
    repeated id with different vectors as well: its best of all). An empty table gives no rows. Other columns are ignored. Scores are exact integers;
    one beyond a long is given as the long's end. Memory follows the block and the batch of queries.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.select("vec_id", "v", "q", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    asked = f"{shared_dir(spark)}/queries"
    rows.where("q").select(F.col("vec_id").alias("qid"), F.col("h1").alias("qh1"), F.col("h2").alias("qh2"), "dim", F.col("v").alias("qv")).dropDuplicates(_QUERY).write.parquet(asked)
    wanted = spark.read.parquet(asked)
    held = checkpoint(entries(rows, k))
    edges = cell_edges(held)
    packed = held.repartition(pieces(vectors, 32 << 20)).mapInArrow(_pack(edges, block), "dim int, n int, h1 binary, h2 binary, first binary, single binary, cells binary")
    found = checkpoint(packed.mapInArrow(_scan(edges, asked, k, queries), "qid long, qh1 long, qh2 long, dim int, h1 long, h2 long, upper double, lower double"))
    # joins by merging: the blocks' list says nothing of how many bounds there are, so Spark must not take them for few
    nth = F.row_number().over(Window.partitionBy(*_QUERY).orderBy(F.desc("lower")))
    enough = found.select(*_QUERY, "lower").withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*_QUERY).agg(F.min("lower").alias("enough"), F.count("*").alias("of"))
    left = checkpoint(found.join(enough.hint("merge"), _QUERY).where((F.col("of") < k) | (F.col("upper") >= F.col("enough"))).select(*_QUERY, "h1", "h2", "upper"))
    # exact vectors of what is left; one that many queries ask for is broadcast (at most a thousand are)
    asks = left.groupBy(*_KEY).agg(F.count("*").alias("n")).join(held.hint("merge"), _KEY)
    read = join_groups(left, asks, _KEY, left.count(), "qid").join(wanted.hint("merge"), _QUERY)

    def exact(key: tuple, table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        whole = table.combine_chunks()
        col = lambda name: whole[name].combine_chunks()
        best = best_of(key[0].as_py(), _matrix(col("qv")[:1], dim)[0], _matrix(col("v"), dim), col("upper").to_numpy(), col("ids").to_pylist(), col("counts").to_pylist(), k)
        ends = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "vec_id": pa.array([j for _, j in best], pa.int64()), "score": pa.array([ends(s) for s, _ in best], pa.int64()), "at": pa.array(range(len(best)), pa.int32())})

    best = read.groupBy(*_QUERY).applyInArrow(exact, "query_id long, vec_id long, score long, at int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
