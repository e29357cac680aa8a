import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import relate as L
from quillstone.plans import views as V

COLUMNS = "id string, doc_id string, chunk_id string, entity string, metric string, fact_type string, value string, unit string, period_label string, basis string, status string, quote string, page_number int, printed_page string, fact_seq long"
SAME, AGAINST, APART = "corroboration", "contradiction", "context_reconcilable"


def fact(i, **over):
    base = {"id": f"f{i}", "doc_id": "atlas", "chunk_id": "atlas:0", "entity": "Harbour Mills Ltd", "metric": "grain milled", "fact_type": "numeric", "value": "40", "unit": "tonnes", "period_label": "2011 to FY12", "basis": None, "status": None, "quote": f"statement {i} of the register", "page_number": i, "printed_page": None, "fact_seq": 10 * i}
    return tuple((base | over).values())


def kinds(spark, *facts):
    df = spark.createDataFrame([fact(i, **f) for i, f in enumerate(facts, 1)], COLUMNS)
    return sorted((r["relation_type"], tuple(r["fact_ids"])) for r in L.relationships(df).collect())


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [
        ({"value": "6,300"}, {"value": "6300.04"}, SAME),
        ({"value": "6,300"}, {"value": "6300.06"}, AGAINST),
        ({"value": "(12)"}, {"value": "-12"}, SAME),
        ({"value": "18", "basis": "Wet weight "}, {"value": "21", "basis": "dry weight"}, APART),
        ({"value": "18", "basis": " DRY weight"}, {"value": "21", "basis": "dry weight"}, AGAINST),
        ({"metric": "grain milled abroad"}, {"metric": "milled grain overseas branch"}, SAME),
        ({"metric": "yield rate", "value": "3%"}, {"metric": "rate yield", "value": "4%"}, AGAINST),
        ({"metric": "keeper", "fact_type": "semantic", "value": "Ada Quill"}, {"metric": "keeper", "fact_type": "semantic", "value": "ada  quill, senior"}, SAME),
        ({"metric": "keeper", "fact_type": "semantic", "value": "Ada Quill"}, {"metric": "keeper", "fact_type": "semantic", "value": "Bo Reed", "period_label": "1999"}, AGAINST),
        ({"metric": "site", "fact_type": "semantic", "value": "7 Mill Lane Oldport North Shore"}, {"metric": "site", "fact_type": "semantic", "value": "Mill Lane 7, North Shore, Oldport"}, SAME),
    ],
)
def test_pairs_relate(spark, a, b, kind):
    assert kinds(spark, a, b) == [(kind, ("f1", "f2"))]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ({}, {"entity": "Harbour Looms"}),
        ({"fact_type": "semantic", "value": "x"}, {"fact_type": "numeric"}),
        ({"value": "1"}, {"value": "2", "period_label": "2013"}),
        ({"value": "1", "period_label": None}, {"value": "1", "period_label": None}),
        ({"basis": "wet"}, {"basis": "dry"}),
        ({"metric": "grain milled abroad"}, {"metric": "milled grain overseas branch", "value": "41"}),
        ({"metric": "grain"}, {"metric": "grain growth", "value": "9"}),
        ({"metric": "winter yield"}, {"metric": "summer yield"}),
        ({"value": "3", "period_label": "2 May 2011"}, {"value": "4", "period_label": "May 3, 2011"}),
        ({"value": "many"}, {"value": "40"}),
        ({"metric": "keeper", "fact_type": "semantic", "value": ""}, {"metric": "keeper", "fact_type": "semantic", "value": "Bo"}),
        ({"metric": "of the"}, {"metric": "of the"}),
        ({"value": "NaN"}, {"value": "40", "unit": "per cent"}),
    ],
)
def test_pairs_do_not_relate(spark, a, b):
    assert kinds(spark, a, b) == []


@pytest.mark.parametrize("period", ["2011", None])
@pytest.mark.parametrize("values", [("7.5", "2.25", "9.75"), ("-3", "10", "7.05"), ("5e15", "3", "5000000000000003"), ("9e14", "-8.99e14", "1e12"), ("2e20", "5e20", "7e20"), ("1e17", "48", "100000000000000048")])
def test_sums(spark, period, values):
    names = ("rye barn stock", "oats", "barn all cereals together")
    got = kinds(spark, *({"metric": m, "value": v, "period_label": period} for m, v in zip(names, values, strict=True)))
    assert [x for x in got if len(x[1]) == 3] == [(APART, ("f1", "f2", "f3"))]


def test_sums_need_a_word_a_bucket_and_two_real_parts(spark):
    triple = lambda ms, vs, **one: kinds(spark, *({"metric": m, "value": v} | (one if i == 1 else {}) for i, (m, v) in enumerate(zip(ms, vs, strict=True))))
    assert triple(("rye", "oats", "corn"), ("1", "2", "3")) == []
    words = ("rye barn", "oats", "barn whole")
    assert triple(words, ("1", "2", "3"))
    assert triple(words, ("1", "2", "3"), basis="dry") == [] == triple(words, ("1", "2", "3"), period_label="2014")
    assert triple(words, ("1", "0.04", "1.04")) == [(SAME, ("f1", "f3"))]  # one part alone is the sum


def _oracle(rows):
    """Pairs and sums of simple facts by the rules, all against all: one entity, year and basis, words of one kind."""
    out = set()
    near = lambda x, y: abs(x - y) <= 0.05
    for (i, m, v), (j, n, w) in itertools.combinations(rows, 2):
        a, b = set(m.split()), set(n.split())
        overlap = 1.0 if a == b else 0.0 if len(a | b) < 3 else len(a & b) / len(a | b)
        if overlap >= (0.2 if near(v, w) else 0.7):
            out.add((SAME if near(v, w) else AGAINST, (i, j)))
    for c, mc, vc in rows:
        for (i, m, v), (j, n, w) in itertools.combinations([r for r in rows if r[0] != c], 2):
            if near(v + w, vc) and not near(v, vc) and not near(w, vc) and set(mc.split()) & (set(m.split()) | set(n.split())):
                out.add((APART, (i, j, c)))
    return out


def test_relations_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(f"f{i}", " ".join(rng.sample(["rye", "oats", "barn", "silo", "east"], rng.randint(1, 3))), rng.randrange(0, 160) / 8) for i in range(1, 41)]
    got = kinds(spark, *({"metric": m, "value": str(v)} for _, m, v in rows))
    assert len(got) == len(set(got)) and set(got) == _oracle(rows)


def test_places_of_far_numbers_stay_apart(spark):
    big = 1 << 40
    rows = [fact(1, page_number=1, value="5", fact_seq=1), fact(2, page_number=1, value="5", quote="another part of it", fact_seq=big + 2), fact(3, page_number=2, value="5", fact_seq=2)]
    got = {tuple(r["fact_ids"]) for r in L.relationships(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {("f1", "f2"), ("f1", "f3"), ("f2", "f3")}


def test_one_statement_extracted_twice_is_one_fact(spark):
    a = {"page_number": 3}
    assert kinds(spark, a | {"quote": "forty tonnes were milled"}, a | {"quote": "as said, FORTY tonnes, were milled here"}) == []
    assert kinds(spark, a | {"quote": "forty tonnes were milled"}, a | {"quote": "we milled forty"}) == [(SAME, ("f1", "f2"))]


def test_dedupe_keeps_the_first_of_a_chain(spark):
    quotes = ["m n", "k m n o", "k m", "", "", "yy", "m n", "YY"]
    df = spark.createDataFrame([fact(i, page_number=1, quote=q) for i, q in enumerate(quotes, 1)], COLUMNS)
    assert sorted(r["id"] for r in L.dedupe(df).collect()) == ["f1", "f3", "f4", "f5", "f6"]
    hot = spark.range(3000).select(F.lit(0).alias("k"), "id").crossJoin(spark.createDataFrame([fact(1)], COLUMNS).drop("id", "fact_seq")).select(F.concat(F.lit("h"), "id").alias("id"), *[c.split()[0] for c in COLUMNS.split(", ")[1:-1]], F.col("id").alias("fact_seq"))
    assert [r["id"] for r in L.dedupe(hot).collect()] == ["h0"]


def test_views(spark):
    df = spark.createDataFrame([fact(1, value="1"), fact(2, value="2"), fact(3, entity="Zed", value="5")], COLUMNS)
    counts, first = V.relationships(df, entity="harbour", limit=1)
    assert [(r["relation_type"], r["n"]) for r in counts.collect()] == [(AGAINST, 1)]
    row = first.first()
    assert [e["fact_id"] for e in row["evidence"]] == ["f1", "f2"] and "grain milled" in row["explanation"]
    assert V.relationships(df, relation_type=SAME)[1].count() == 0 == V.relationships(df, entity="zed")[1].count()
    assert V.relationships(df.limit(0))[0].count() == 0
    for call in (lambda: V.facts_page(df, limit=0), lambda: V.facts_page(df, offset=-1), lambda: V.relationships(df, limit=2001), lambda: V.relationships(df, relation_type="x"), lambda: V.rejections(df, limit=0)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        V.existing(V.fact(df, "none"), "fact")
    assert V.existing(V.fact(df, "f3"), "fact").first()["entity"] == "Zed"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_not_joined_again(spark):
    df = spark.createDataFrame([fact(1)], COLUMNS)
    assert "Join" not in _plan(L.dedupe(df)) and set(L.dedupe(df).columns) >= {*df.columns, "pos", "tokens"}


@pytest.mark.parametrize("few", [0, 1000])
def test_small_and_large_groups_have_the_same_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    test_relations_against_all_pairs(spark)


def test_counts_need_no_evidence(spark):
    df = spark.createDataFrame([fact(i, value=str(i)) for i in range(1, 4)], COLUMNS)
    counts, page = V.relationships(df, entity="harbour", limit=2)
    assert "__fact" not in _plan(counts) and {r["relation_type"]: r["n"] for r in counts.collect()} == {AGAINST: 3, APART: 1}
    assert [[e["fact_id"] for e in r["evidence"]] for r in page.collect()] == [["f1", "f2"], ["f1", "f3"]]
