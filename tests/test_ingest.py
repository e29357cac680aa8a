import json

import pytest
from pyspark.sql import functions as F

from quillstone import schemas as S
from quillstone.operators import chunks as H
from quillstone.operators import grounding as G
from quillstone.operators import identity as I
from quillstone.operators import pages as P
from quillstone.operators import responses as R
from quillstone.plans import pipeline as plan
from quillstone.plans import views as V
from quillstone.sources import files as files_
from quillstone.streaming.ingest import ingest_stream


def labels(spark, texts):
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string")
    return [r["printed_page"] for r in P.printed_pages(df).orderBy("page_number").collect()]


def test_candidates(spark):
    texts = ["38\nA heading", "x" * 75 + " 44", "61234 is too long", "1931\n0\n3001", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.printed_candidates(F.col("t"))).collect()]
    assert got == [[38], [], [], [1931], []]


def test_printed_runs(spark):
    assert labels(spark, [f"head\n{n}" for n in range(14, 27)]) == [str(n) for n in range(14, 27)]
    assert labels(spark, [f"1931\n{n}\n{n * 53}" for n in range(14, 27)]) == [str(n) for n in range(14, 27)]
    runs = [*range(31, 40), *range(61, 72)]
    assert labels(spark, [f"p\n{n}" for n in runs]) == [str(n) for n in runs]
    sheets = labels(spark, [f"{2 * i + 40}  {2 * i + 41}" for i in range(12)])
    assert sheets[0] == "40-41" and sheets[7] == "54-55"
    assert labels(spark, ["nothing"] * 4) == [None] * 4


def test_chunks_cover_and_overlap():
    pages = [(i, ("word " * 150 + ". ") * 3) for i in range(1, 9)] + [(9, "")]
    spine = H.Spine(pages)
    whole = spine.text
    got = H.cut(pages)
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    assert all(len(c["text"]) <= S.CHUNK_CHARS for c in got)
    at, end = 0, 0
    for c in got:
        start = whole.index(c["text"], max(0, end - S.CHUNK_OVERLAP - 1) if end else 0)
        assert start <= end
        end = start + len(c["text"])
        assert c["char_offset"] == max(0, start - spine.start[c["page_start"] - 1])
    assert end == len(whole) and at == 0


def test_chunk_edges(spark):
    assert H.cut([(1, " "), (2, "\n")]) == []
    assert len(H.cut([(1, "short")])) == 1
    assert H.cut([(1, "x" * 20000)], 1000, 200)[-1]["text"].endswith("x")
    with pytest.raises(ValueError):
        H.cut([(1, "x")], 100, 100)
    empty = spark.createDataFrame([], "doc_id string, page_number int, text string")
    assert H.chunk_pages(empty).count() == 0


@pytest.mark.parametrize("text", ['[{"a": 1}]', '```json\n[{"a": 1}]\n```', '```\n[{"a": 1}]\n```', 'Here: [{"a": 1}] done'])
def test_salvage(text):
    assert R.salvage(text) == ([{"a": 1}], None)


@pytest.mark.parametrize(("text", "why"), [("nothing", "no JSON array"), ("[1, 2", "no JSON array"), ("[1][2]", "not valid JSON"), ('{"a": 1}', "expected a JSON array"), (None, "no JSON array"), ("null", "no JSON array")])
def test_salvage_fails(text, why):
    assert why in R.salvage(text)[1]


GOOD = {"entity": "A", "metric": "m", "fact_type": " Numeric", "quote": "a quote that is long"}


@pytest.mark.parametrize(("over", "key", "want"), [({"confidence": 1.7}, "confidence", 1.0), ({"confidence": -0.3}, "confidence", 0.0), ({}, "confidence", 0.5), ({"confidence": float("nan")}, "confidence", 0.0), ({"unit": "  "}, "unit", None), ({"value": 81415.38}, "value", None), ({"page": 3}, "dimensions", '{"page": 3}')])
def test_shape(over, key, want):
    assert R.shape(GOOD | over)[0][key] == want


@pytest.mark.parametrize("raw", [5, GOOD | {"entity": " "}, GOOD | {"fact_type": "odd"}, GOOD | {"quote": "four"}, GOOD | {"confidence": "high"}, GOOD | {"confidence": None}, {k: GOOD[k] for k in ("entity", "metric", "quote")}])
def test_shape_rejects(raw):
    assert R.shape(raw)[0] is None


def test_grounding(spark):
    pages = spark.createDataFrame([("d", 22, None, "nothing here"), ("d", 23, "19", "Mill output was\n  5,731.09 tonnes"), ("d", 24, None, "Mill output was 5,731.09 tonnes")], "doc_id string, page_number int, printed_page string, text string")
    quotes = spark.createDataFrame([(1, "d", 22, 24, "mill output was 5,731.09"), (2, "d", 22, 24, "mill output was 5,731.08"), (3, "d", 22, 22, "mill output was 5,731.09"), (4, "d", 22, 24, "6.5"), (5, "e", 1, 2, "mill output was 5,731.09")], "k int, doc_id string, page_start int, page_end int, quote string")
    got = {r["k"]: (r["grounded"], r["page_number"], r["printed_page"], r["reason"]) for r in G.ground(quotes, pages, "k").collect()}
    assert got[1] == (True, 23, "19", None)
    assert got[2][3] == got[3][3] == "quote not found on any page in range"
    assert got[4][3] == "quote too short to be evidence" and got[5][3] == "no pages in chunk range"


def reply(prompt):
    return json.dumps([GOOD | {"quote": "alpha beta gamma delta", "value": "1"}, GOOD | {"quote": "not in the text at all"}, 7])


def test_ingest_then_extract_twice(spark, tmp_path):
    for name, text in (("b.txt", "alpha beta gamma delta\fpage two of it"), ("a.txt", "alpha beta gamma delta\fpage two of it"), ("c.txt", "quite another\fone"), ("d.pdf", "x")):
        (tmp_path / name).write_text(text)
    files = files_.read_files(spark, str(tmp_path), "*.txt")
    pages = files_.extract_pages(files.dropDuplicates(["doc_id"]), files_.form_feed_pages)
    tables = plan.ingest(files, pages)
    assert sorted(r["filename"] for r in tables["documents"].collect()) == ["a.txt", "c.txt"]
    assert plan.ingest(files, pages, tables["documents"])["documents"].count() == 0
    assert plan.ingest_summary(tables).first()["pages"] == 4
    cache = spark.createDataFrame([], S.RESPONSES)
    got = plan.extract(tables["chunks"], tables["pages"], cache, reply)
    assert got["answers"].count() == 2
    assert [(r["page_number"], r["value"]) for r in got["facts"].collect()] == [(1, "1")]
    assert sorted(r["stage"] for r in got["rejections"].collect()) == ["grounding"] * 3 + ["shape"] * 2
    path = str(tmp_path / "cache")
    files_.upsert_table(spark, got["answers"], path, "content_hash", "prompt_version")
    again = plan.extract(tables["chunks"], tables["pages"], spark.read.parquet(path), reply)
    assert again["answers"].count() == 0 and again["facts"].count() == 1
    files_.upsert_table(spark, got["answers"], path, "content_hash", "prompt_version")
    assert spark.read.parquet(path).count() == 2


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, I.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in I.dangling(new, old, "k", "k").collect()] == [3]


def test_sampling(spark):
    chunks = spark.createDataFrame([(f"d:{i}", "d", i, i, i) for i in range(10)], "id string, doc_id string, chunk_index int, page_start int, page_end int")
    assert sorted(r["chunk_index"] for r in V.sampled_chunks(chunks, 3).collect()) == [0, 3, 6]
    required = spark.createDataFrame([(1, "d", 4), (0, "d", 7), (2, "d", 4)], "rank int, doc_id string, page_number int")
    assert sorted((r["rank"], r["id"]) for r in V.covering_chunks(chunks, required).collect()) == [(0, "d:7"), (1, "d:4")]


def test_streamed_documents_are_added_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "a", "same"), ("2", "b", "same"), ("3", "c", None)], "doc_id string, filename string, text string").write.parquet(source)
    for more in ([], [("4", "d", "same"), ("5", "e", "new")]):
        if more:
            spark.createDataFrame(more, "doc_id string, filename string, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id string, filename string, text string").parquet(source)
        ingest_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["filename"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c", "e"]


def test_pages_of_chunks_against_all_pages():
    import random

    rng = random.Random(4)
    for _ in range(300):
        pages = [(i + 1, rng.choice(["", "a", "b c", "long text here", "\n"])) for i in range(rng.randint(1, 7))]
        spine = H.Spine(pages)
        spans = list(zip(spine.start.tolist(), spine.end.tolist(), strict=True))
        a = rng.randrange(0, max(1, len(spine.text)))
        b = rng.randint(a + 1, len(spine.text) + 1)
        touched = [i for i, (s, e) in enumerate(spans) if s < b and e > a]
        first, last = spine.pages_of(a, b)
        assert (first, last) == ((touched[0], touched[-1]) if touched else (max([0, *(i for i, (s, _) in enumerate(spans) if s <= a)]),) * 2)


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([("1", "it is quite remarkable evidence of that"), ("2", "inquite remarkable evidences"), ("3", "nothing"), ("4", "aaaaextraordinarinessbbb one"), ("5", ""), ("6", "go on extraordinarily x")], "doc_id string, page string")
    quotes = ["quite remarkable evidence", "remarkable evidence", "extraordinariness", "t is quite remarkable evidence of th", "is quite remarkable evidence", "n extraordinaril", "unheard-of quote"]
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    want = {(i, d["doc_id"]) for i, q in enumerate(quotes) for d in docs.collect() if q in d["page"]}
    got = [tuple(r) for r in G.holding(docs, items).collect()]
    assert len(want) == 8 and sorted(got) == sorted(want)
    assert G.holding(docs, items.limit(0)).count() == 0


def test_extraction_counts_and_order(spark, tmp_path):
    pages = spark.createDataFrame([("d", i, None, f"page {i}: alpha beta gamma delta " + "x" * 50) for i in range(1, 4)] + [("e", 1, None, "alpha beta gamma delta")], "doc_id string, page_number int, printed_page string, text string")
    chunks = H.chunk_pages(pages, 60, 10).persist()
    cache, kept, seen = [spark.createDataFrame([], S.RESPONSES)], [], []

    def save(new):
        cache[0] = R.stored(cache[0], new).persist()

    def keep(got):
        kept.append({k: v.collect() for k, v in got.items()})

    told = plan.run_extraction(chunks, pages, lambda: cache[0], save, reply, keep, 2, lambda *x: seen.append(x))
    n = chunks.count()
    assert told["chunks"] == n and seen[-1] == (n, n) and len(seen) == 2
    assert told["calls_made"] == chunks.select("content_hash").distinct().count()
    assert told["facts"] == sum(len(k["facts"]) for k in kept) > 0 and told["rejections"] == sum(len(k["rejections"]) for k in kept)
    again = plan.run_extraction(chunks, pages, lambda: cache[0], save, reply, keep)
    assert again["calls_made"] == 0 and again["facts"] == told["facts"]
    facts = plan.extract(chunks, pages, cache[0], reply)["facts"]
    first = plan.numbered(facts, spark.createDataFrame([], S.FACTS))
    more = plan.numbered(facts, first)
    rows = [r["chunk_id"] for r in first.orderBy("fact_seq").collect()]
    assert rows == sorted(rows, key=lambda c: (c[0], int(c[2:]))) and first.agg(F.max("fact_seq")).first()[0] < more.agg(F.min("fact_seq")).first()[0]


def test_first_chunk_and_existence(spark):
    chunks = spark.createDataFrame([(f"d:{i}", "d", i, i, i + 1) for i in range(5)], "id string, doc_id string, chunk_index int, page_start int, page_end int")
    required = spark.createDataFrame([(0, "d", 3), (1, "d", 9), (2, "x", 1)], "rank int, doc_id string, page_number int")
    assert [tuple(r) for r in V.first_covering_chunk(chunks, required).collect()] == [(0, "d:2")]
    assert {r["id"] for r in plan.priority_chunks(chunks, required, 1).collect()} == {"d:2", "d:3", "d:0"}
    asked = spark.createDataFrame([("d:1",), ("zz",)], "key string")
    assert {tuple(r) for r in V.existence(asked, chunks, "key").collect()} == {("d:1", True), ("zz", False)}
