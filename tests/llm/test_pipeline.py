import corpus_pipeline as pipeline
from quillstone.llm.common import load

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality":
            assert len(after) > 0.7 * len(before) and all(after[k] == before[k] for k in after)
        if name == "near_copies":
            found = brute.components([(k, r["text"]) for k, r in before.items()])
            assert set(after) == {c for _, _, c in found}
        if name == "repeats":
            for k, n, gone, _ in brute.repeats([(k, r["text"]) for k, r in before.items()]):
                assert len(brute.words(after[k]["text"])) == n - gone
                assert gone or after[k]["text"] == before[k]["text"]
                assert after[k]["n_chars"] == len(after[k]["text"] or "")
        if name == "mixing":
            for k, r in after.items():
                own, got = brute.words(before[k]["text"]), brute.words(r["text"])
                assert 0 < len(got) <= 3 * len(own) and got == (own * 3)[: len(got)]
        if name == "packing":
            pieces = {}
            for r in rows:
                pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
            assert set(pieces) == set(before)
            for some in pieces.values():
                at = 0
                for start, length, total in sorted(some):
                    assert start == at
                    at += length
                assert at == total
        else:
            before = after


def test_run_gives_the_last_stage(spark):
    got = pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_stages_take_null_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{i % 97}x{i % 13}" for i in range(400))
    rows = [(1, long, None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, long + " more", "fr", "b", 5), (None, "a lone text of seven words here", "en", "a", 31), (5, "x", None, None, None), (5, "x", None, None, None)]
    names = ["chunk", "bucket", "kind", "keep", "kept", "row", "extra", "size", "rank", "of", "key", "id", "part"]
    docs = spark.createDataFrame([r + (1,) * len(names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert (out.count() > 0) == (some is docs)
            if name != "packing":
                assert out.columns == docs.columns
    copies = {r["doc_id"] for r in pipeline.near_copies(spark, docs, SF).collect()}
    assert copies == {1, 2, 3, None, 5}


def test_stages_keep_different_texts_of_one_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(5, a), (5, b), (6, b), (6, c), (None, c), (None, d)]], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.near_copies(spark, docs, SF).persist()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == [(-1, c), (-1, d), (5, a), (5, b)]
    mixed = pipeline.mix_sources(spark, left, SF).collect()
    assert sorted(r["text"][0] for r in mixed) == ["a", "b", "c", "d"]
