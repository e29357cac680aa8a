"""N-gram Jaccard join by universe partition and the generalised pigeonhole.

Two sets of sizes r and s have a Jaccard likeness of 4/5 or more exactly if their symmetric difference
is at most H = (r + s) // 9. Hashing cuts the universe of shingles into m > H segments, so sets that
link agree on at least m - H segments, and of a record's segments any choice with sum(v + 1) > H
allowed errors v holds one within its allowance: v = 0 asks for an equal segment, v = 1 for one that
is equal after one deletion on one side, v = -1 skips the segment. Size bands of ratio 5/4 fix m; a
record is indexed in its own band and probes its own and the next. Segments have slack (m is 1.4 times
what is needed), and the first few of each band are indexed with their one-deletion neighbourhoods;
each probe takes the cheapest allocation by the number of records that share each signature.

Steps: equal sets are collapsed; a few segments give star edges that, once verified, connect most of
every group; then all segments are exchanged and only pairs of different components are verified with
their whole sets. Components come from alternating large and small stars. Nothing is expanded into
all pairs of a group, and no step caps candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, few_files, join_groups, load, mix, pieces, remove_dir, shared_dir, shingle_sets, strings
from .substring import _cut, _packed_bits, _parts, messages

SHINGLE = 5
NEIGHBOURHOODS = 4
STARS = 4
#: Groups of so many entries that share a signature, with so many pairs for each entry, are told apart by sketches of so many times the usual width.
LARGE, WORTH, WIDER = 64, 16, 4
_U = np.uint64
_FIRST = -(1 << 63)


def _bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, one more than needed."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, np.int64)


def segments_of(low: np.ndarray, band: np.ndarray) -> np.ndarray:
    """How many segments a band has: the most that can differ between two of its records, one, and slack."""
    most = 2 * (low[band + 1] - 1) // 9 + 1
    return (most * 7 + 4) // 5 + 1


class _Records:
    """The distinct shingle sets of a chunk's representative rows, and their segment signatures."""

    def __init__(self, table: pa.Table, wanted: np.ndarray) -> None:
        """wanted: (sorted) ids to keep."""
        ids = table["doc_id"].combine_chunks().to_numpy()
        at = np.searchsorted(wanted, ids)
        keep = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == ids)) if len(wanted) else np.zeros(0, np.int64)
        keep = keep[np.argsort(ids[keep], kind="stable")]
        self.ids = ids[keep]
        texts = strings(table["text"]).take(pa.array(keep)) if len(keep) else pa.array([], pa.string())
        self.values, self.offs = shingle_sets(texts, SHINGLE)
        self.size = np.diff(self.offs)

    def entries(self, band_shift: int, only: int | None = None):
        """Signatures in band + band_shift of the records that can have partners there.

        Returns key, record, segment (the number in its record) and whether a token was deleted, in
        order of record, exact ones before deletions; and the least units each record needs.
        """
        low = _bands(int(self.size.max(initial=1)))
        band = np.searchsorted(low, self.size, "right") - 1
        most = self.size * 5 // 4
        use = self.size > 0
        if band_shift:
            use &= most >= low[band + 1]
        rec = np.flatnonzero(use)
        band = band[rec] + band_shift
        count = segments_of(low, band)
        partner = np.minimum(most[rec], low[band + 1] - 1)
        need = (self.size[rec] + partner) // 9 + 1
        base = np.cumsum(count) - count
        size = self.size[rec]
        place = np.repeat(np.arange(len(rec)), size)
        token = self.values[np.repeat(self.offs[rec] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] if len(rec) else np.zeros(0, np.uint64)
        spread = mix(token ^ _U(0xA24BAED4963EE407))
        segment = (spread % count.astype(np.uint64)[place]).astype(np.int64) if len(rec) else np.zeros(0, np.int64)
        slot = base[place] + segment
        total = np.zeros(int(count.sum()), np.uint64)
        weight = mix(token + _U(0x9FB21C651E98DF25))
        np.add.at(total, slot, weight)
        owner = np.repeat(np.arange(len(rec)), count)
        number = np.arange(len(owner)) - base[owner]
        salt = mix((band.astype(np.uint64)[owner] << _U(32)) + number.astype(np.uint64))
        key = mix(total ^ salt)
        if only is not None:
            some = (number < only) & (np.bincount(slot, minlength=len(total)) > 0)
            return key[some], rec[owner[some]]
        near = np.flatnonzero(segment < NEIGHBOURHOODS)
        key = np.concatenate([key, mix((total[slot[near]] - weight[near]) ^ salt[slot[near]])])
        who = np.concatenate([owner, place[near]])
        number = np.concatenate([number, segment[near]])
        deleted = np.arange(len(key)) >= len(owner)
        return key, rec[who], number, deleted, dict(zip(rec.tolist(), need.tolist(), strict=True))

    def all_entries(self):
        """Both bands' entries: key, record, deleted, probe only; and per band what allocate() needs."""
        parts = [self.entries(0), self.entries(1)]
        key, rec = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        deleted = np.concatenate([p[3] for p in parts])
        probe_only = np.repeat([False, True], [len(p[0]) for p in parts])
        return key, rec, deleted, probe_only, parts


    def sketches(self, rec: np.ndarray, probe_only: np.ndarray, times: int = 1) -> list[bytes]:
        """Of record rec[i] in its own or the next band the parity of its shingles at `times` sketch_bits() places.

        Two sketches of a band differ in at most as many bits as the sets' symmetric difference has members.
        """
        low = _bands(int(self.size.max(initial=1)))
        bits = times * sketch_bits(low, np.searchsorted(low, self.size[rec], "right") - 1 + probe_only)
        size = self.size[rec]
        base = np.cumsum(bits) - bits
        place = np.repeat(np.arange(len(rec)), size)
        token = self.values[np.repeat(self.offs[rec] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        at = base[place] + (mix(token + _U(0x5851F42D4C957F2D)) % bits.astype(np.uint64)[place]).astype(np.int64)
        odd = np.packbits(np.bincount(at, minlength=int(bits.sum())) & 1 == 1).tobytes() if len(rec) else b""
        return [odd[a : a + n] for a, n in zip((base // 8).tolist(), (bits // 8).tolist(), strict=True)]


def sketch_bits(low: np.ndarray, band: np.ndarray) -> np.ndarray:
    return 64 * (-(-low[band + 1] // 64) + 1)


def allocate(rec: np.ndarray, number: np.ndarray, deleted: np.ndarray, need: dict[int, int], cost: np.ndarray) -> np.ndarray:
    """Which entries a probe uses: a cheapest allocation with more units than the most differing segments.

    cost is the number of other records with the entry's signature. All segments at v = 0 have more
    units than needed, so the dearest are skipped; a neighbourhood (v = 1) lets one more be skipped
    where that is cheaper. Entries that cost nothing are never sent, so they are not marked either.
    """
    active = np.zeros(len(rec), bool)
    order = np.argsort(rec, kind="stable")
    some = np.unique(rec[cost > 0])
    lo, hi = np.searchsorted(rec[order], some), np.searchsorted(rec[order], some, "right")
    for r, a, b in zip(some.tolist(), lo.tolist(), hi.tolist(), strict=True):
        own = order[a:b]
        exact = own[~deleted[own]]
        c = cost[exact]
        by = exact[np.argsort(-c, kind="stable")]
        spare = len(exact) - need[r]
        left = by[spare:]
        left = left[cost[left] > 0]
        if len(left):
            more = own[deleted[own]]
            skipped = set(by[:spare].tolist())
            extra = np.bincount(number[more], cost[more], minlength=NEIGHBOURHOODS)
            near = sorted((x for x in exact.tolist() if number[x] < NEIGHBOURHOODS and x not in skipped), key=lambda x: extra[number[x]])
            drop = left.tolist()  # the dearest first
            for x in near:
                if drop and x in drop and drop[0] == x:
                    continue
                if not drop or extra[number[x]] >= cost[drop[0]]:
                    break
                gone = drop.pop(0)
                active[gone] = False
                active[x] = True
                active[more[number[more] == number[x]]] = True
                if x in drop:
                    drop.remove(x)
            active[drop] = True
    return active & (cost > 0)


def _tagged(df: DataFrame, chunk: str, **cols: str) -> DataFrame:
    """Rows for the right side of a cogroup: chunk, kind and whatever of a, b, s and n is given."""
    types = {"a": "long", "b": "long", "s": "binary", "n": "long"}
    out = [F.lit(cols["kind"]).alias("kind")] + [(F.col(cols[c]) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select(F.col(chunk).alias("chunk"), *out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and two sums of hashes that stand for the set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values, offs = shingle_sets(strings(part.column(1)), SHINGLE)
                row = np.repeat(np.arange(part.num_rows), np.diff(offs))
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                    total = np.zeros(part.num_rows, np.uint64)
                    np.add.at(total, row, mix(values ^ _U(salt)))
                    sums.append(total.view(np.int64))
                yield pa.record_batch({"doc_id": part.column(0), "n_shingles": np.diff(offs), "x": sums[0], "y": sums[1]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, x long, y long")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, root: of every node of the edges (a, b) the smallest node that it is connected to.

    Alternating large and small stars; each round is one checkpoint (of at most `files` files, if given)
    and the rounds grow with the logarithm of the longest path.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    total, before = 2 * now.count(), None

    def starred(rows: DataFrame) -> DataFrame:
        """Rows u, v with the smallest v of their u (m); a hub may have a third of all rows."""
        return join_groups(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], total, "v")

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = starred(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = starred(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = checkpoint(small, files)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


class _Join:
    """The steps over a table of texts that is dealt by id once, into `parts` buckets of bounded size."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark, self.parts = docs.sparkSession, pieces(docs, 4 << 20)
        self.buckets, self.files = self.parts, few_files(docs)
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), "text")
        self.name, self.path = f"quillstone_{uuid.uuid4().hex}", shared_dir(self.spark)
        dealt = rows.withColumn("chunk", self.chunk("doc_id")).repartition(self.parts, "chunk")
        dealt.write.bucketBy(self.parts, "chunk").option("path", f"{self.path}/texts").option("compression", "zstd").format("parquet").saveAsTable(self.name)

    def chunk(self, col: str):
        return F.pmod(F.xxhash64(col), F.lit(self.parts))

    def cogroup(self, right: DataFrame, run, schema: str) -> DataFrame:
        return self.spark.table(self.name).groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)

    def star_pairs(self, reps: DataFrame) -> DataFrame:
        """For each record at most two leaders (the smallest record of a signature), those of most of its first segments."""

        def run(_: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            r = _Records(table, np.sort(right["a"].to_numpy()))
            key, rec = r.entries(0, STARS)
            return pa.table({"key": key.view(np.int64), "id": r.ids[rec]})

        found = self.cogroup(_tagged(reps, "chunk", kind="rep", a="id"), run, "key long, id long")
        groups = found.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader")
        pairs = found.join(groups, "key").where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
        best = pairs.groupBy("id").agg(F.max(F.struct("n", (-F.col("leader")).alias("l"))).alias("x"), F.min("leader").alias("m"))
        two = best.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array(-F.col("x.l"), F.col("m")))).alias("b"))
        return two

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are alike. b's set travels once to each chunk that asks for it."""
        pairs = pairs.withColumn("to", self.chunk("a"))
        asks = pairs.select("b", "to").distinct().withColumn("chunk", self.chunk("b"))

        def send(_: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            ids, to = right["b"].to_numpy(), right["n"].to_numpy()
            r = _Records(table, np.unique(ids))
            sets: dict[int, list[bytes]] = {}
            for i, x in enumerate(r.ids.tolist()):
                sets.setdefault(x, []).append(r.values[r.offs[i] : r.offs[i + 1]].astype("<u8").tobytes())
            rows = [(t, x, s) for x, t in zip(ids.tolist(), to.tolist(), strict=True) for s in sets.get(x, [])]
            return pa.table({"to": pa.array([x[0] for x in rows], pa.int64()), "b": pa.array([x[1] for x in rows], pa.int64()), "s": pa.array([x[2] for x in rows], pa.binary())})

        sets = self.cogroup(_tagged(asks, "chunk", kind="ask", b="b", n="to"), send, "to long, b long, s binary")

        def compare(_: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            kind = np.array(right["kind"].to_pylist(), object)
            asked, come = right.filter(pa.array(kind == "pair")), right.filter(pa.array(kind == "set"))
            other: dict[int, list[np.ndarray]] = {}
            for b, s in zip(come["b"].to_pylist(), come["s"], strict=True):
                other.setdefault(b, []).append(np.frombuffer(s.as_buffer(), "<u8"))
            r = _Records(table, np.unique(asked["a"].to_numpy()))
            place: dict[int, list[int]] = {}
            for i, x in enumerate(r.ids.tolist()):
                place.setdefault(x, []).append(i)
            good = []
            for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
                good.append(any(_alike(r.values[r.offs[i] : r.offs[i + 1]], s) for i in place.get(a, []) for s in other.get(b, [])))
            return asked.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        right = _tagged(sets, "to", kind="set", b="b", s="s").unionByName(_tagged(pairs, "to", kind="pair", a="a", b="b"))
        return checkpoint(self.cogroup(right, compare, "a long, b long").repartition(self.files))

    def cross_pairs(self, reps: DataFrame) -> DataFrame:
        """All pairs (probe, indexed) of different components that the allocation and the sketches leave to verify. reps: id, root, chunk."""
        buckets = self.buckets
        right = _tagged(reps, "chunk", kind="rep", a="id", b="root")

        def bucket_of(key: np.ndarray) -> np.ndarray:
            return ((key >> _U(32)) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)

        def records(table: pa.Table, right: pa.Table) -> tuple:
            mine = right.filter(pa.array(np.array(right["kind"].to_pylist(), object) == "rep"))
            ids, roots = mine["a"].to_numpy(), mine["b"].to_numpy()
            order = np.argsort(ids)
            r = _Records(table, ids[order])
            return r, roots[order][np.searchsorted(ids[order], r.ids)] if len(r.ids) else np.zeros(0, np.int64)

        def send(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            r, _ = records(table, right)
            keys = r.all_entries()[0]
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            parts = _parts(bucket[order])
            return messages(key[0].as_py(), parts, keys=_cut(keys.astype("<u4")[order], parts))

        def count(_: tuple, table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x.as_buffer(), "<u4") for x in table["keys"]]
            keys = np.concatenate(parts)
            _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
            # 0: alone; c: fewer than 2^c others
            level = np.ceil(np.log2(n)).astype(np.uint8)[inverse]
            ends = np.cumsum([len(p) for p in parts])
            return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "levels": pa.array([level[b - len(p) : b].tobytes() for p, b in zip(parts, ends.tolist(), strict=True)], pa.binary())})

        def shared_entries(table: pa.Table, right: pa.Table) -> tuple:
            """What is shared and sent, in bucket order: an index entry of the own band, or an active probe."""
            r, roots = records(table, right)
            keys, rec, deleted, probe_only, parts = r.all_entries()
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            got = {n: np.frombuffer(s.as_buffer(), np.uint8) for k, n, s in zip(right["kind"].to_pylist(), right["n"].to_pylist(), right["s"], strict=True) if k == "levels"}
            level = np.zeros(len(keys), np.uint8)
            level[order] = np.concatenate([got[b] for b in np.unique(bucket).tolist()]) if len(keys) else level
            cost = np.where(level > 0, np.exp2(level.astype(float)), 0)
            cut = len(parts[0][0])
            active = np.concatenate([allocate(p[1], p[2], p[3], p[4], c) for p, c in zip(parts, (cost[:cut], cost[cut:]), strict=True)])
            some = np.flatnonzero((level > 0) & (~probe_only | active))
            some = some[np.argsort(bucket[some], kind="stable")]
            return r, roots, keys, rec, deleted, probe_only, bucket, active, some

        def send_roots(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            _, roots, keys, rec, _, _, bucket, active, some = shared_entries(table, right)
            root, who, parts = [], [], _parts(bucket[some])
            for _, a, b in parts:
                own, index = np.unique(roots[rec[some[a:b]]], return_inverse=True)
                root.append(own.astype("<i8").tobytes())
                who.append(index.astype("<u4").tobytes())
            asking = _packed_bits(active[some], np.array([b - a for _, a, b in parts], np.int64))
            return messages(key[0].as_py(), parts, keys=_cut(keys[some], parts), roots=root, who=who, active=asking)

        def mixed(_: tuple, table: pa.Table) -> pa.Table:
            """Which entries share their signature with another component and a probe, and which of them in a large group of many pairs."""
            parts = [np.frombuffer(x.as_buffer(), "<u8") for x in table["keys"]]
            root = np.concatenate([np.frombuffer(x.as_buffer(), "<i8")[np.frombuffer(w.as_buffer(), "<u4")] for x, w in zip(table["roots"], table["who"], strict=True)])
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(least, inverse, root)
            np.maximum.at(most, inverse, root)
            size = np.array([len(p) for p in parts])
            active = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table["active"], size.tolist(), strict=True)])
            n, asking = np.bincount(inverse), np.bincount(inverse, active)
            shared = (least < most) & (asking > 0)
            large = shared & (n >= LARGE) & (asking >= WORTH)
            if large.any():  # pairs within a component are none
                some = np.flatnonzero(large[inverse])
                _, which = np.unique(root[some], return_inverse=True)
                own, at, count = np.unique(inverse[some] * (which.max() + 1) + which, return_inverse=True, return_counts=True)
                within = np.bincount(own // (which.max() + 1), np.bincount(at, active[some]) * count, len(n))
                large &= asking * n - within >= WORTH * n
            bits = [a + b for a, b in zip(_packed_bits(shared[inverse], size), _packed_bits(large[inverse], size), strict=True)]
            return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

        def send_shared(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            r, roots, keys, rec, deleted, probe_only, bucket, active, some = shared_entries(table, right)
            got = {n: s for k, n, s in zip(right["kind"].to_pylist(), right["n"].to_pylist(), right["s"], strict=True) if k == "mixed"}
            bits = [[np.unpackbits(x, count=to - at) for x in np.frombuffer(got[b].as_buffer(), np.uint8).reshape(2, -1)] for b, at, to in _parts(bucket[some])]
            mixed, large = (np.concatenate([np.zeros(0, np.uint8), *x]) > 0 for x in zip(*bits, strict=True)) if bits else (np.zeros(0, bool),) * 2
            some, large = some[mixed], large[mixed]
            code = 2 * rec[some] + probe_only[some]
            sketch, wide = (dict(zip(drawn.tolist(), r.sketches(drawn >> 1, drawn & 1, times), strict=True)) for drawn, times in ((np.unique(code), 1), (np.unique(code[large]), WIDER)))
            names, sizes, root, who, flags, odd, wider, parts = [], [], [], [], [], [], [], _parts(bucket[some])
            for _, a, b in parts:
                own, index = np.unique(code[a:b], return_inverse=True)
                odd.append(b"".join(sketch[x] for x in own.tolist()))
                wider.append(b"".join(wide[x] for x in np.unique(code[a:b][large[a:b]]).tolist()))
                own = own >> 1
                names.append(r.ids[own].astype("<i8").tobytes())
                sizes.append(r.size[own].astype("<u4").tobytes())
                root.append(roots[own].astype("<i8").tobytes())
                who.append(index.astype("<u4").tobytes())
                flags.append((active[some[a:b]] + 2 * deleted[some[a:b]] + 4 * probe_only[some[a:b]] + 8 * large[a:b]).astype(np.uint8).tobytes())
            return messages(key[0].as_py(), parts, keys=_cut(keys[some], parts), names=names, sizes=sizes, roots=root, who=who, flags=flags, sketches=odd, wider=wider).drop_columns("chunk")

        def pairs(_: tuple, table: pa.Table) -> pa.Table:
            raw = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
            who = raw("who", "<u4")
            pick = lambda name, kind: np.concatenate([x[w] for x, w in zip(raw(name, kind), who, strict=True)])
            key, flags = np.concatenate(raw("keys", "<u8")), np.concatenate(raw("flags", np.uint8))
            ids, size, root = pick("names", "<i8"), pick("sizes", "<u4").astype(np.int64), pick("roots", "<i8")
            low = _bands(int(size.max(initial=1)))
            words = sketch_bits(low, np.searchsorted(low, size, "right") - 1 + (flags >> 2 & 1)) // 64 * np.where(flags & 8, WIDER, 1)
            held, place, base = [], [], 0
            for sizes, own, f, *odd in zip(raw("sizes", "<u4"), who, raw("flags", np.uint8), raw("sketches", "<u8"), raw("wider", "<u8"), strict=True):
                later, wide = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
                later[own] = f >> 2 & 1
                wide[own[f & 8 > 0]] = True
                n = sketch_bits(low, np.searchsorted(low, sizes, "right") - 1 + later) // 64
                m = n * WIDER * wide
                place.append(base + np.where(f & 8, len(odd[0]) + (np.cumsum(m) - m)[own], (np.cumsum(n) - n)[own]))
                base += len(odd[0]) + len(odd[1])
                held += odd
            held, place = np.concatenate(held), np.concatenate(place)
            order = np.argsort(key, kind="stable")
            key, flags, ids, size, root, words, place = (x[order] for x in (key, flags, ids, size, root, words, place))
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(start[1:], len(key))
            mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            busy = np.maximum.reduceat(flags & 1, start) > 0
            found = [np.zeros((0, 2), np.int64)]
            for a, b in zip(start[mixed & busy].tolist(), end[mixed & busy].tolist(), strict=True):
                f, i, n, t = flags[a:b], ids[a:b], size[a:b], root[a:b]
                y = np.flatnonzero(f & 4 == 0)
                step = max(1, (1 << 20) // ((b - a) * int(words[a])))
                for lo in range(0, b - a, step):  # a block of probes against the whole group
                    x = lo + np.flatnonzero(f[lo : lo + step] & 1)
                    if not len(x) or not len(y):
                        continue
                    p, q = x[:, None], y[None, :]
                    ok = (t[p] != t[q]) & (4 * n[q] <= 5 * n[p]) & ((f[p] & 2 == 0) | (f[q] & 2 == 0))
                    ok &= (n[p] < n[q]) | (n[p] == n[q]) & (i[p] < i[q])
                    u, v = np.nonzero(ok)
                    if len(u):  # the sketches' distance is no more than the sets'
                        odd = held[place[a:b, None] + np.arange(words[a])]
                        far = np.bitwise_count(odd[x[u]] ^ odd[y[v]]).sum(1)
                        close = 9 * far <= n[x[u]] + n[y[v]]
                        u, v = u[close], v[close]
                    found.append(np.stack([i[x[u]], i[y[v]]], 1))
            out = np.unique(np.concatenate(found), axis=0)
            return pa.table({"a": out[:, 0], "b": out[:, 1]})

        sent = self.cogroup(right, send, "chunk long, bucket long, keys binary")
        levels = sent.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(count, "chunk long, bucket long, levels binary")
        more = right.unionByName(_tagged(levels, "chunk", kind="levels", n="bucket", s="levels"))
        told = self.cogroup(more, send_roots, "chunk long, bucket long, keys binary, roots binary, who binary, active binary")
        bits = told.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(mixed, "chunk long, bucket long, bits binary")
        more = more.unionByName(_tagged(bits, "chunk", kind="mixed", n="bucket", s="bits"))
        shared = self.cogroup(more, send_shared, "bucket long, keys binary, names binary, sizes binary, roots binary, who binary, flags binary, sketches binary, wider binary")
        return checkpoint(shared.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct(), self.files)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_dir(self.spark, self.path)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |a & b| >= 80 * |a | b|, of sorted distinct values."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id (smallest id reachable by links) of every row.

    Rows link from a Jaccard likeness of 0.8 on. Null, empty and blank texts have no shingles, link
    with nothing and are components of their own. Repeated rows are equal sets; rows of one id with
    different texts are one node. A null id counts as the smallest and is given back as null. An
    empty table gives no rows; other columns are ignored.
    """
    files = few_files(docs)
    rows = checkpoint(fingerprints(docs).repartition(files))
    total = rows.count()
    classes = checkpoint(rows.where("n_shingles > 0").groupBy("n_shingles", "x", "y").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), files)
    named = join_groups(rows, classes, ["n_shingles", "x", "y"], total, "doc_id", alone=F.col("n_shingles") == 0)
    named = checkpoint(named.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), files)
    # an id with several texts joins their classes
    twice = named.where("n_shingles > 0").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("a", "b")
    join = _Join(docs)
    try:
        reps = checkpoint(classes.select(F.col("class_id").alias("id")).distinct().withColumn("chunk", join.chunk("id")), files)
        links = join.verified(join.star_pairs(reps)).unionByName(twice)
        roots = components(links, files)
        known = reps.join(roots, F.col("id") == F.col("node"), "left").select("id", "chunk", F.coalesce("root", "id").alias("root"))
        links = links.unionByName(join.verified(join.cross_pairs(checkpoint(known, files))))
        sized = classes.groupBy("class_id").agg(F.sum("n").alias("n"))
        roots = components(links, files).select(F.col("node").alias("class_id"), "root").join(sized, "class_id")
        out = join_groups(named, roots, ["class_id"], total, "doc_id", alone=F.col("n_shingles") == 0)
        real = lambda c: F.when(F.col(c) != _FIRST, F.col(c))
        out = out.withColumn("root", F.coalesce("root", "class_id"))
        return checkpoint(out.select(real("doc_id").alias("doc_id"), "n_shingles", real("class_id").alias("class_id"), real("root").alias("component_id")), files)
    finally:
        join.close()


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON node = d.doc_id
"""
