"""Quality classifier by co-training.

Two views judge a document: its text (hashed words and statistics of its characters) and its metadata
(language, source, length). For each of two questions, low quality and toxic, each view is a logistic
regression. Over rounds each view labels the unlabelled documents it is surest of for the other one.
The views' scores are then calibrated on held-out labels and combined.

The first fit uses a bounded sample of labelled rows (`labelled`), which also chooses the words that
count. Then all other documents, however many, are reduced once to a row of some hundred bytes each (which of those
words they hold, statistics, metadata), and each round is a pass over that table: the rows that one
view is sure of add to the other view's sums of gradients and second derivatives, which are summed in
a tree and make its next Newton step. The driver holds the labelled rows' features and these sums.
Scoring covers every row and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffer_of, checkpoint, load, lower_ascii, mix, ragged, slices, strings, word_hashes, word_spans

#: Bound of the labelled rows, buckets of the word hash and of metadata, words a model uses, rounds, surety,
#: what a class's pseudo-labelled rows weigh together against its labelled ones, sums added in one step of the tree.
LABELLED = 12_000
BUCKETS = 1 << 21
#: Besides whole words, their first bytes.
PREFIXES = (4, 6)
META = 256
WORDS = 192
ROUNDS = 3
PENALTY, META_PENALTY = 1.0, 5.0
SURE = 0.98
TRUST = 0.5
FAN_IN = 16
#: Rows of a design matrix that the driver makes at once.
BLOCK = 1024
HELD_OUT = 0.25
QUESTIONS = ("low_quality", "toxic")
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:?", b"!", b"|", b"#$%&*@^~=+<>", b"'\"()-")
N_STATS = len(_KINDS) + 6
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def text_features(col: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct word buckets (with row offsets) and statistics."""
    flat, offsets, stats, base = [], [np.zeros(1, np.int64)], [], 0
    for _, part in slices(strings(col), 1 << 20):
        raw, offs = buffer_of(part)
        n = len(part)
        starts, ends, first = word_spans(raw, offs)
        row = np.repeat(np.arange(n), np.diff(first))
        a, b = starts.copy(), ends.copy()
        for _ in range(3):  # punctuation around words
            go = (b - a > 1) & _PUNCT[raw[np.minimum(a, len(raw) - 1)]] if len(raw) else np.zeros(0, bool)
            a = a + go
            go = (b - a > 1) & _PUNCT[raw[b - 1]] if len(raw) else go
            b = b - go
        words = word_hashes(lower_ascii(raw), a, b) if len(raw) else np.zeros(0, np.uint64)
        marks = [(words, row)]
        for k in PREFIXES:
            longer = np.flatnonzero(b - a > k)
            if len(longer):
                marks.append((mix(word_hashes(lower_ascii(raw), a[longer], a[longer] + k) ^ np.uint64(k)), row[longer]))
        code = np.unique(np.concatenate([r * buckets + (w % np.uint64(buckets)).astype(np.int64) for w, r in marks]))
        owner = code // buckets
        flat.append((code % buckets).astype(np.int32))
        per = np.bincount(owner, minlength=n)
        offsets.append(base + np.cumsum(per))
        base += len(code)
        size = np.maximum(1, np.diff(offs)).astype(float)
        kinds = np.zeros(256, np.int64)
        for i, k in enumerate(_KINDS):
            kinds[list(k)] = i + 1
        owner_of_byte = np.repeat(np.arange(n), np.diff(offs))
        table = np.bincount(owner_of_byte * (len(_KINDS) + 1) + kinds[raw], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, 1:] / size[:, None]
        count = np.maximum(1, np.diff(first)).astype(float)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        length = np.bincount(row, b - a, minlength=n) / count
        stops = np.bincount(row, (ends - b) + (a - starts), minlength=n) / count
        more = [np.log1p(np.diff(first)), np.log1p(size), per / count, np.bincount(row, same, minlength=n) / count, length, stops]
        stats.append(np.column_stack([table, *more]))
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), np.concatenate(offsets), (np.concatenate(stats) if stats else np.zeros((0, N_STATS)))


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Of each row four buckets of META: language, source, both, half powers of two of the length; null is a value of its own."""
    import xxhash

    code = lambda *x: xxhash.xxh3_64_intdigest(repr(x).encode()) % META
    return np.array([[code("l", a), code("s", b), code("ls", a, b), code("n", None if c is None else int(2 * np.log2(max(c, 0) + 1)))] for a, b, c in zip(lang, source, n_chars, strict=True)], np.int64).reshape(-1, 4)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blocks(x: np.ndarray | View) -> Iterator[tuple[int, np.ndarray]]:
    return x.blocks() if isinstance(x, View) else iter([(0, x)])


def fit_logistic(x: np.ndarray | View, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, steps: int = 8) -> np.ndarray:
    """Newton's method; the last coefficient is the intercept, whose column a View has already."""
    x = x if isinstance(x, View) else np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.width if isinstance(x, View) else x.shape[1])
    p = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    w[-1] = np.log(p / (1 - p))
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        w = _step(w, *_sums(x, w, y, weight), penalty)
    return w


@dataclass
class Question:
    """A combined model: word buckets and their weights, statistics, metadata buckets, calibration."""

    prior: float = -5.0
    fitted: bool = False
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    word_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_STATS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_STATS))
    text: np.ndarray = field(default_factory=lambda: np.zeros(N_STATS + 1))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META + 1))
    text_fit: tuple = (1.0, 0.0)
    meta_fit: tuple = (1.0, 0.0)
    combine: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    @property
    def text_weights(self) -> np.ndarray:
        return np.concatenate([self.word_weights, self.text])

    def set_text(self, w: np.ndarray) -> None:
        self.word_weights, self.text = w[: len(self.words)], w[len(self.words) :]

    def text_score(self, flat: np.ndarray, offs: np.ndarray, stats: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, flat)
        known = self.words[np.minimum(at, len(self.words) - 1)] == flat if len(self.words) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[known]
        return np.bincount(row, self.word_weights[at[known]], minlength=len(offs) - 1) + ((stats - self.mean) / self.scale) @ self.text[:-1] + self.text[-1]

    def meta_score(self, meta: np.ndarray) -> np.ndarray:
        return self.meta[:-1][meta].sum(1) + self.meta[-1]

    def probability(self, flat, offs, stats, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, of the metadata view, and of both."""
        if not self.fitted:
            p = np.full(len(offs) - 1, _sigmoid(np.array([self.prior]))[0])
            return p, p, p
        a = self.text_fit[0] * self.text_score(flat, offs, stats) + self.text_fit[1]
        b = self.meta_fit[0] * self.meta_score(meta) + self.meta_fit[1]
        both = np.clip(np.column_stack([a, b]), -12, 12) @ self.combine[:2] + self.combine[2]
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


class Rows:
    """Reduced documents: which words of the vocabulary each holds (ragged), statistics and metadata buckets."""

    def __init__(self, words: np.ndarray, offs: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> None:
        self.words, self.offs, self.stats, self.meta = words, offs, stats, meta
        self.n = len(offs) - 1

    @classmethod
    def packed(cls, words: pa.Array, stats: pa.Array, meta: pa.Array) -> Rows:
        parts = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in words]
        whole = lambda col, kind, width: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in col)]).reshape(-1, width)
        return cls(np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), whole(stats, "<f8", N_STATS), whole(meta, "<i8", 4))

    def part(self, at: np.ndarray) -> Rows:
        lens = np.diff(self.offs)[at]
        return Rows(self.words[ragged(self.offs[:-1][at], lens)], np.concatenate([[0], np.cumsum(lens)]), self.stats[at], self.meta[at])

    def text(self, q: Question, vocabulary: np.ndarray) -> np.ndarray:
        """The text view's design matrix for a question."""
        column = np.full(len(vocabulary) + 1, -1)
        column[np.searchsorted(vocabulary, q.words)] = np.arange(len(q.words))
        out = np.zeros((self.n, len(q.words) + N_STATS + 1))
        at, row = column[self.words], np.repeat(np.arange(self.n), np.diff(self.offs))
        out[row[at >= 0], at[at >= 0]] = 1
        out[:, len(q.words) : -1] = (self.stats - q.mean) / q.scale
        out[:, -1] = 1
        return out

    def metadata(self) -> np.ndarray:
        out = np.zeros((self.n, META + 1))
        np.add.at(out, (np.repeat(np.arange(self.n), 4), self.meta.ravel()), 1)
        out[:, -1] = 1
        return out


class View:
    """Rows of a design matrix with an intercept, made a block at a time: whole, it would be the driver's largest object."""

    def __init__(self, rows: Rows, make: Callable[[Rows], np.ndarray], at: np.ndarray | None = None) -> None:
        self.rows, self.make, self.at = rows, make, np.arange(rows.n) if at is None else at

    @property
    def width(self) -> int:
        return self.make(self.rows.part(self.at[:0])).shape[1]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, use: np.ndarray) -> View:
        return View(self.rows, self.make, self.at[use])

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(0, len(self.at), BLOCK):
            yield i, self.make(self.rows.part(self.at[i : i + BLOCK]))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(x @ w for _, x in self.blocks())])


def _sums(x: np.ndarray | View, w: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the logistic likelihood at w."""
    g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for at, b in _blocks(x):
        p = _sigmoid(b @ w)
        own = 1.0 if weight is None else weight[at : at + len(b)]
        g += b.T @ (own * (y[at : at + len(b)] - p))
        h += (b * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ b
    return g, h


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    return w + np.linalg.solve(h + np.diag(ridge), g - ridge * w)


def _loss(score: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_sigmoid(score), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def sure_sums(models: dict[str, Question], vocabulary: np.ndarray, rows: Rows, sure: float = SURE) -> np.ndarray:
    """For each question, view and label: number, gradient and second derivatives of the rows that the other view is sure of, as one vector."""
    out, meta = [], rows.metadata()
    for q in models.values():
        if not q.fitted:
            continue
        text = rows.text(q, vocabulary)
        views = ((text, q.text_weights, q.text_fit), (meta, q.meta, q.meta_fit))
        for (x, w, _), (other, v, fit) in zip(views, views[::-1], strict=True):
            p = _sigmoid(fit[0] * (other @ v) + fit[1])
            for label in (0, 1):
                some = np.flatnonzero((p if label else 1 - p) >= sure)
                g, h = _sums(x[some], w, np.full(len(some), float(label)))
                out += [[len(some)], g, h.ravel()]
    return np.concatenate([np.zeros(0), *out])


def _calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = fit_logistic(score[:, None], y, 0.1)
    return max(float(w[0]), 0.0), float(w[1])


def cotrain(rows: Rows, vocabulary: np.ndarray, models: dict[str, Question], final: dict[str, np.ndarray], answers: dict[str, np.ndarray], held: np.ndarray, others: Callable[[dict[str, Question]], np.ndarray | None], rounds: int = ROUNDS) -> dict[str, Question]:
    """Fits the models (whose words are chosen) on labelled rows; `others` gives sure_sums() of all unlabelled documents.

    final has the words that all rows choose, held-out ones included; answers has 1 or 0 for each row and question. Held-out rows calibrate. A view's step is taken only if its
    held-out loss does not rise by over a twentieth.
    """
    live = {name: q for name, q in models.items() if q.fitted}
    text, meta = {name: View(rows, partial(Rows.text, q=q, vocabulary=vocabulary)) for name, q in live.items()}, View(rows, Rows.metadata)
    for name, q in live.items():
        y = answers[name]
        q.set_text(fit_logistic(text[name][~held], y[~held], PENALTY))
        q.meta = fit_logistic(meta[~held], y[~held], META_PENALTY)
        q.text_fit, q.meta_fit = _calibrated(text[name][held] @ q.text_weights, y[held]), _calibrated(meta[held] @ q.meta, y[held])

    def steps(q: Question, name: str, sums: np.ndarray | None, at: int, use: np.ndarray) -> tuple[list, int]:
        """The next weights of both views from labelled rows and the sums of the sure ones."""
        out, y = [], answers[name]
        for x, w, penalty in ((text[name], q.text_weights, PENALTY), (meta, q.meta, META_PENALTY)):
            g, h = _sums(x[use], w, y[use])
            for label in (0, 1) if sums is not None else ():
                n, d = sums[at], len(w)
                weight = min(1.0, TRUST * (y[use] == label).sum() / max(1.0, n))
                g, h = g + weight * sums[at + 1 : at + 1 + d], h + weight * sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
                at += 1 + d + d * d
            out.append(_step(w, g, h, penalty))
        return out, at

    for _ in range(rounds if live else 0):
        sums = others(models)
        if sums is None:
            break
        at = 0
        for name, q in live.items():
            y = answers[name][held]
            (words, more), at = steps(q, name, sums, at, ~held)
            for x, new, view in ((text[name][held], words, "text"), (meta[held], more, "meta")):
                old, fit = (q.text_weights, q.text_fit) if view == "text" else (q.meta, q.meta_fit)
                own = _calibrated(x @ new, y)
                if _loss(own[0] * (x @ new) + own[1], y) <= 1.05 * _loss(fit[0] * (x @ old) + fit[1], y):
                    q.set_text(new) if view == "text" else setattr(q, "meta", new)
                    setattr(q, f"{view}_fit", own)
    for name, q in live.items():
        y = answers[name][held]
        a, b = (f[0] * (x @ w) + f[1] for x, w, f in ((text[name][held], q.text_weights, q.text_fit), (meta[held], q.meta, q.meta_fit)))
        both = np.clip(np.column_stack([a, b]), -12, 12)
        w = fit_logistic(both, y, 0.3)
        if w[1] < 0:  # metadata that misleads does not count
            w = np.insert(fit_logistic(both[:, :1], y, 0.3), 1, 0.0)
        q.combine = np.array([max(w[0], 0.1), w[1], w[2]])
    # the calibration stands; the views, with the words that all labelled rows choose, see the held-out rows too
    for name, q in live.items():
        q.words = final[name]  # so the text view has other columns from here on
        q.set_text(fit_logistic(text[name], answers[name], PENALTY))
        q.meta = fit_logistic(meta, answers[name], META_PENALTY)
    sums, at = others(models) if live and rounds else None, 0
    for name, q in live.items() if sums is not None else ():
        (words, more), at = steps(q, name, sums, at, np.ones(rows.n, bool))
        q.set_text(words)
        q.meta = more
    return models


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    return docs.select(pick("doc_id", "long"), pick("text", "string"), pick("lang", "string"), pick("source", "string"), pick("n_chars", "long"))


def _features(batch: pa.RecordBatch, at: int) -> tuple:
    """Of columns at, at + 1, ...: text, lang, source, n_chars."""
    return *text_features(strings(batch.column(at))), meta_features(*(batch.column(i).to_pylist() for i in range(at + 1, at + 4)))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Features of the labelled rows of the smallest hashes of their ids (one row an id), and their ids; `most` at most."""
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sample = checkpoint(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = _columns(docs).join(F.broadcast(sample), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source"))
    chosen = chosen.withColumn("__nth", one).where("__nth = 1").drop("__nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                flat, offs, stats, meta = _features(some, 1)
                raw = [flat[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                place = mix(some.column(0).to_numpy().astype(np.uint64)).view(np.int64)
                yield pa.record_batch({"place": place, "tie": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "y0": some.column(5), "y1": some.column(6), "flat": pa.array(raw, pa.binary()), "stats": pa.array([s.tobytes() for s in stats], pa.binary()), "meta": pa.array([m.tobytes() for m in meta], pa.binary())})

    seen = chosen.select("doc_id", "text", "lang", "source", "n_chars", *QUESTIONS).mapInArrow(run, "place long, tie long, y0 int, y1 int, flat binary, stats binary, meta binary")
    return checkpoint(seen.withColumn("held", F.pmod("place", F.lit(round(1 / HELD_OUT))) == 0)), sample


def _chosen_words(seen: DataFrame, most: int = WORDS) -> dict[str, np.ndarray]:
    """For each question the word buckets that lean most significantly to one side over these labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, BUCKETS), np.int32)
        for batch in batches:
            for raw, *y in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = np.frombuffer(raw.as_buffer(), np.int32)
                for i, label in enumerate(y):
                    total[2 * i + label, words] += 1
        some = np.flatnonzero(total.any(0))
        yield pa.record_batch({"word": pa.array(some, pa.int64()), **{f"n{i}": pa.array(total[i, some], pa.int64()) for i in range(4)}})

    fit = seen.select("flat", "y0", "y1")
    size = fit.agg(*[F.coalesce(F.sum((F.col(f"y{i // 2}") == i % 2).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(4)]).first()
    table = checkpoint(fit.mapInArrow(count, "word long, n0 long, n1 long, n2 long, n3 long").groupBy("word").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]))
    out = {}
    for i, name in enumerate(QUESTIONS):
        no, yes = F.col(f"n{2 * i}"), F.col(f"n{2 * i + 1}")
        all_no, all_yes = max(1, size[2 * i]), max(1, size[2 * i + 1])
        p = (no + yes) / (all_no + all_yes)
        z = (yes / all_yes - no / all_no) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / all_yes + 1 / all_no))
        best = table.where(no + yes >= 3).select("word", F.abs(z).alias("z")).where("z > 6").orderBy(F.desc("z"), "word").limit(most).collect()
        out[name] = np.array(sorted(r["word"] for r in best), np.int64)
    return out


def _reduced(flat: np.ndarray, offs: np.ndarray, stats: np.ndarray, meta: np.ndarray, vocabulary: np.ndarray) -> dict:
    at = np.searchsorted(vocabulary, flat)
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    words, ends = at[known].astype("<u2"), np.concatenate([[0], np.cumsum(known)])[offs]
    return {"words": pa.array([words[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()), "stats": pa.array([x.tobytes() for x in stats.astype("<f8")], pa.binary()), "meta": pa.array([x.tobytes() for x in meta.astype("<i8")], pa.binary())}


def unlabelled(docs: DataFrame, sample: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """words, stats, meta (packed) of every row whose id has no label in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield pa.record_batch(_reduced(*_features(batch.slice(at, 512), 0), vocabulary))

    rest = _columns(docs).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")  # `labelled` ids at most
    return checkpoint(rest.select("text", "lang", "source", "n_chars").mapInArrow(run, "words binary, stats binary, meta binary"))


def tree_sum(parts: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """The sum of packed vectors (part, v), `fan_in` at a time, in the order of their parts."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = 0
        for x in table["v"]:
            total = total + np.frombuffer(x.as_buffer(), "<f8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    count = (parts.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    while count > 1:
        parts, count = checkpoint(parts.groupBy(F.floor(F.col("part") / fan_in).alias("to")).applyInArrow(add, "part long, v binary")), -(-count // fan_in)
    row = parts.first()
    return np.frombuffer(row["v"], "<f8") if row else None


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Question]:
    """A model for each question. labels has doc_id, quality (1 good) and toxic (1 toxic); of repeated ids the worse label counts.

    Fits on at most `labelled` label rows, those of the smallest hash of their ids, and on all other documents by pseudo-labels;
    of documents that share a labelled id one is fitted on. Without labels of both kinds (four of each, one of them held out) a
    question's answer is its prior, under one half.
    """
    seen, sample = _labelled(docs, labels, labelled)
    words, final = _chosen_words(seen.where("NOT held")), _chosen_words(seen)
    vocabulary = np.unique(np.concatenate([*words.values(), *final.values()])).astype(np.int64)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(x.as_buffer(), np.int32) for x in batch["flat"]]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
            stats = np.array([np.frombuffer(x.as_buffer()) for x in batch["stats"]]).reshape(-1, N_STATS)
            meta = np.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch["meta"]], np.int64).reshape(-1, 4)
            some = _reduced(np.concatenate([np.zeros(0, np.int32), *flat]), offs, stats, meta, vocabulary)
            yield pa.record_batch({c: batch[c] for c in ("place", "tie", "y0", "y1", "held")} | some)

    got = seen.mapInArrow(reduce, "place long, tie long, y0 int, y1 int, held boolean, words binary, stats binary, meta binary").toArrow()
    got = got.sort_by([("place", "ascending"), ("tie", "ascending")])  # some hundred bytes for each of `labelled` rows
    rows = Rows.packed(got["words"], got["stats"], got["meta"])
    held = got["held"].to_numpy()
    answers = {name: got[y].to_numpy().astype(np.int64) for name, y in zip(QUESTIONS, ("y0", "y1"), strict=True)}
    models = {}
    for name, y in answers.items():
        q = models[name] = Question(words=words[name])
        if rows.n and min(np.bincount(y, minlength=2).tolist()) >= 4 and len(np.unique(y[held])) == 2 == len(np.unique(y[~held])):
            q.fitted = True
            q.mean, q.scale = rows.stats[~held].mean(0), rows.stats[~held].std(0) + 1e-3
        else:
            share = np.clip(y.mean() if rows.n else 0.01, 0.01, 0.49)
            q.prior = float(np.log(share / (1 - share)))
    if not any(q.fitted for q in models.values()):
        return models
    table = unlabelled(docs, sample, vocabulary)

    def others(now: dict[str, Question]) -> np.ndarray | None:
        shared = docs.sparkSession.sparkContext.broadcast(now)  # some hundred weights each

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    some = batch.slice(at, 4096)
                    total = total + sure_sums(shared.value, vocabulary, Rows.packed(*some.columns))
            if not isinstance(total, int):
                yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

        return tree_sum(checkpoint(table.mapInArrow(run, "part long, v binary")))

    return cotrain(rows, vocabulary, models, final, answers, held, others, rounds)


def score(docs: DataFrame, models: dict[str, Question], carry: bool = False) -> DataFrame:
    """Of every row p_<question> of both views and of each (_text, _meta), and keep: no question's answer is yes.

    With carry all columns of docs come first, as they were, in a struct, row; else doc_id alone. Null and empty texts
    are judged by their statistics and metadata; a missing or null metadata column is a value of its
    own. Repeated rows are judged alike, an empty table gives no rows.
    """
    have = docs.columns if carry else ["doc_id"]
    held = [f"__carry{i}" for i in range(len(have))]
    clean = _columns(docs).columns
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(have, held, strict=True)), *(((F.col(c) if c in docs.columns else F.lit(None)).cast("long" if c == "n_chars" else "string")).alias(c) for c in clean[1:]))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # some hundred weights each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                features = _features(some, len(held))
                out, yes = dict(zip(held, some.columns, strict=False)), np.zeros(some.num_rows, bool)
                for name, q in shared.value.items():
                    text, meta, both = q.probability(*features)
                    out |= {f"p_{name}": both, f"p_{name}_text": text, f"p_{name}_meta": meta}
                    yes |= both >= 0.5
                yield pa.RecordBatch.from_pydict(out | {"keep": pa.array(~yes)})

    schema = "".join(f"{h} {rows.schema[h].dataType.simpleString()}, " for h in held) + "".join(f"p_{n} double, p_{n}_text double, p_{n}_meta double, " for n in models) + "keep boolean"
    out = rows.mapInArrow(run, schema)
    first = F.struct(*(F.col(h).alias(c) for c, h in zip(have, held, strict=True))).alias("row") if carry else F.col(held[0]).alias("doc_id")
    return out.select(first, *out.columns[len(held) :])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels"))).select("doc_id", "p_low_quality", "p_toxic", "keep")
