"""Relationships between facts: corroboration, contradiction, reconciliation.

Candidates share the entity and a word of the metric, numeric facts the year and being a percentage as
well; every threshold on the words' overlap is above 0, so none is lost. Small groups are joined whole,
large ones on the words. Three-way sums meet on the bucket, a shared word and the bin of the missing addend. A fact's
place in order, pos, is its bucket's first fact_seq and its own. Evidence is attached at the end.
"""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.claims import flat, same_meaning, token_overlap, values_match, with_claims
from ..functions.text import stripped

EVIDENCE = ("doc_id", "entity", "metric", "value", "period_label", "basis", "status", "page_number", "printed_page", "quote")
#: Powers of two: figures up to twice 2^46 have bins of 2^(46 - 49), larger ones of their own exponent less 49.
_SCALE, _STEPS = 46, 49
#: Groups of up to this many facts are joined whole, larger ones by their words.
FEW = 32
#: What the rules read of a fact.
_READ = ("id", "entity_key", "fact_type", "tokens", "num", "year", "day", "pct", "basis_key", "meaning", "value", "period_label")
_HELD: WeakKeyDictionary[SparkSession, DataFrame] = WeakKeyDictionary()


def dedupe(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One fact for each statement extracted twice; facts come back with claims and pos, their place in order.

    Facts of one document, page, entity and value are taken in order of fact_seq; one goes if its
    quote equals, holds or is held by that of one already kept. Equal quotes are one before they are
    compared, and only buckets with several are. Empty quotes equal none. Rows pass those steps
    themselves, so none is read or joined twice; keep names the columns wanted (none: all).
    """
    rows = with_claims(facts.drop("pos")).withColumns({"__e": flat(F.col("entity")), "__v": flat(F.col("value"))})
    bucket = ["doc_id", "page_number", "__e", "__v"]
    row = F.struct(*(keep or [c for c in rows.columns if not c.startswith("__")]))
    own = F.when(F.col("quote_form") == "", F.struct("fact_seq", "id"))
    one = rows.groupBy(*bucket, F.col("quote_form").alias("q"), own.alias("own")).agg(F.min(F.struct("fact_seq", "id")).alias("f"), F.min_by(row, F.struct("fact_seq", "id")).alias("row"))
    some = F.array_sort(F.collect_list(F.when(F.col("q") != "", F.struct("f.fact_seq", "f.id", "q", "row"))))
    blank = F.collect_list(F.when(F.col("q") == "", F.struct("f.fact_seq", "f.id", "q", "row")))
    of = one.groupBy(*bucket).agg(some.alias("all"), blank.alias("blank"), F.min("f.fact_seq").alias("first"))
    clash = lambda acc, x: F.exists(acc, lambda k: F.contains(k["q"], x["q"]) | F.contains(x["q"], k["q"]))
    folded = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.concat(F.when(F.size("all") > 1, folded).otherwise(F.col("all")), "blank")
    return of.select("first", F.explode(kept).alias("k")).select("k.row.*", F.struct("first", F.col("k.fact_seq").alias("seq")).alias("pos"))


def _bucket(entity: Column, year: Column | None = None, basis: Column | None = None) -> list[Column]:
    """The bucket whose first fact leads a relation: the entity for pairs, entity, year (-1: none) and basis for sums."""
    year = F.lit(-1) if year is None else F.coalesce(year, F.lit(-1))
    return [entity.alias("of_entity"), year.alias("of_year"), (F.lit("") if basis is None else basis).alias("of_basis")]


def _sides(facts: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    one = facts.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    two = facts.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    return one, two


def candidate_pairs(deduped: DataFrame, numeric: bool) -> DataFrame:
    """Pairs a before b of one entity and kind with a shared metric word, once each, with the columns that the rules need.

    Numeric facts relate only within a year that both have, as percentages or as other figures.
    """
    kind = F.col("fact_type") == "numeric"
    if numeric:
        rows, alike = deduped.where(kind & F.col("num").isNotNull() & F.col("year").isNotNull()), ["entity_key", "year", "pct"]
        need = ["pos", "id", *alike, "tokens", "num", "day", "period_label", "basis_key"]
    else:
        rows, alike = deduped.where(~F.coalesce(kind, F.lit(False)) & F.col("fact_type").isNotNull() & (F.coalesce("value", F.lit("")) != "")), ["entity_key", "fact_type"]
        need = ["pos", "id", *alike, "tokens", "meaning"]
    few, many = _by_size(rows.select(*need), alike)
    return _pairs_of_few(few, alike, need).unionByName(_pairs_of_many(many, alike, need))


def _by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of up to FEW, and those of larger ones."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW).drop("n")
    return rows.join(large, keys, "left_anti").select(*rows.columns), rows.join(large, keys, "left_semi").select(*rows.columns)


def _pairs_of_few(rows: DataFrame, alike: list[str], need: list[str]) -> DataFrame:
    """All pairs of each group with a shared word."""
    a, b = _sides(rows, need)
    on = reduce(lambda x, c: x & (a[f"a_{c}"] == b[f"b_{c}"]), alike, a["a_pos"] < b["b_pos"])
    return a.join(b, on).where((F.col("a_id") != F.col("b_id")) & F.arrays_overlap("a_tokens", "b_tokens"))


def _pairs_of_many(rows: DataFrame, alike: list[str], need: list[str]) -> DataFrame:
    """The same by a join on the words; the first shared one alone makes the pair, so pairs need no distinct."""
    a, b = _sides(rows.withColumn("t", F.explode("tokens")), [*need, "t"])
    first = F.col("a_t") == F.array_min(F.array_intersect("a_tokens", "b_tokens"))
    on = reduce(lambda x, c: x & (a[f"a_{c}"] == b[f"b_{c}"]), alike, a["a_t"] == b["b_t"])
    return a.join(b, on).where((F.col("a_pos") < F.col("b_pos")) & (F.col("a_id") != F.col("b_id"))).where(first).drop("a_t", "b_t")


def numeric_relation(a: str = "a_", b: str = "b_") -> Column:
    """Of a candidate pair: same year, kind of figure and entity."""
    col = lambda s, c: F.col(s + c)
    days = col(a, "day") & col(b, "day") & (stripped(col(a, "period_label")) != stripped(col(b, "period_label")))
    same_basis, equal = col(a, "basis_key") == col(b, "basis_key"), F.coalesce(values_match(col(a, "num"), col(b, "num")), F.lit(False))
    overlap = token_overlap(col(a, "tokens"), col(b, "tokens"))
    least = F.when(~col(a, "pct") & equal, S.OVERLAP_EQUAL).otherwise(S.OVERLAP_DIFFERING)
    sound = (overlap >= least) & ~F.coalesce(days, F.lit(False))
    return F.when(sound & same_basis & equal, S.RELATIONS[0]).when(sound & same_basis, S.RELATIONS[1]).when(sound & ~equal, S.RELATIONS[2])


def semantic_relation(a: str = "a_", b: str = "b_") -> Column:
    col = lambda s, c: F.col(s + c)
    sound = token_overlap(col(a, "tokens"), col(b, "tokens")) >= S.OVERLAP_SEMANTIC
    return F.when(sound & same_meaning(col(a, "meaning"), col(b, "meaning")), S.RELATIONS[0]).when(sound, S.RELATIONS[1])


def pairwise(deduped: DataFrame) -> DataFrame:
    """relation_type, positions (array), fact_ids and the bucket of every pair that relates."""

    def related(numeric: bool) -> DataFrame:
        kind = numeric_relation() if numeric else semantic_relation()
        found = candidate_pairs(deduped, numeric).withColumn("relation_type", kind).where("relation_type IS NOT NULL")
        return found.select("relation_type", F.lit(0).alias("family"), F.array("a_pos", "b_pos").alias("positions"), F.array("a_id", "b_id").alias("fact_ids"), *_bucket(F.col("a_entity_key")))

    return related(True).unionByName(related(False))


def additive(deduped: DataFrame) -> DataFrame:
    """Two facts that add up to a third of the same entity, year (or none) and basis, one of them sharing a word with it."""
    sums = deduped.where((F.col("fact_type") == "numeric") & ~F.col("pct") & F.col("num").isNotNull() & ~F.isnan("num") & (F.abs("num") < float("inf")))
    sums = sums.select("pos", "id", "entity_key", "year", "basis_key", "tokens", "num")
    # a sum takes three facts, so smaller buckets have none
    known = ["entity_key", F.coalesce("year", F.lit(-1)).alias("__year"), "basis_key"]
    enough = sums.groupBy(*known).agg(F.count("*").alias("n")).where("n > 2").drop("n")
    sums = sums.withColumn("__year", known[1]).join(enough, ["entity_key", "__year", "basis_key"], "left_semi").select(*sums.columns)
    near = lambda x, y: F.abs(x - y) <= F.lit(S.TOLERANCE)
    col = lambda s, c: F.col(f"{s}_{c}")
    side = lambda s: sums.select(*[F.col(c).alias(f"{s}_{c}") for c in sums.columns])
    c, x, y = side("c"), side("x"), side("y")
    same = lambda p, q: (col(p, "entity_key") == col(q, "entity_key")) & col(p, "year").eqNullSafe(col(q, "year")) & (col(p, "basis_key") == col(q, "basis_key"))
    # bins are 1/8 wide, but 8 steps of a double where figures are so large that this is more
    scale = lambda *of: F.greatest(F.lit(_SCALE), *(F.floor(F.log2(F.abs(v))).cast("int") for v in of))
    in_bin = lambda v, e: F.floor(v / F.pow(F.lit(2.0), e - F.lit(_STEPS)))
    ct, xt = c.withColumn("c_t", F.explode("c_tokens")), x.withColumn("x_t", F.explode("x_tokens"))
    first = F.col("c_t") == F.array_min(F.array_intersect("c_tokens", "x_tokens"))
    with_word = ct.join(xt, same("c", "x") & (F.col("c_t") == F.col("x_t"))).where((F.col("c_id") != F.col("x_id")) & first & ~near(F.col("x_num"), F.col("c_num"))).drop("c_t", "x_t")
    probe = with_word.withColumn("scale", scale(F.col("c_num"), F.col("x_num")))
    middle = in_bin(F.col("c_num") - F.col("x_num"), F.col("scale"))
    probe = probe.withColumn("bin", F.explode(F.array(middle - 1, middle, middle + 1)))
    # addends are in the bins of the usual scale, and of the scales of their own bucket's large figures
    usual = y.withColumn("y_scale", F.lit(_SCALE))
    large = sums.where(F.abs("num") >= 2.0 ** (_SCALE + 1)).select("entity_key", "year", "basis_key", scale(F.col("num")).alias("y_scale")).distinct().where(F.col("y_scale") > _SCALE)
    large = large.select(*[F.col(k).alias(f"s_{k}") for k in ("entity_key", "year", "basis_key")], "y_scale")
    other = y.join(large, same("y", "s")).select(*y.columns, "y_scale")
    indexed = usual.unionByName(other).withColumn("y_bin", in_bin(F.col("y_num"), F.col("y_scale")))
    joined = probe.join(indexed, same("c", "y") & (F.col("scale") == F.col("y_scale")) & (F.col("bin") == F.col("y_bin")))
    before = F.col("x_pos") < F.col("y_pos")
    a_num, b_num = F.when(before, F.col("x_num")).otherwise(F.col("y_num")), F.when(before, F.col("y_num")).otherwise(F.col("x_num"))
    # where both addends share a word with the sum, the earlier one alone probes, so sums need no distinct
    once = before | ~F.arrays_overlap("y_tokens", "c_tokens")
    ok = once & (F.col("y_id") != F.col("c_id")) & (F.col("y_id") != F.col("x_id")) & ~near(F.col("y_num"), F.col("c_num")) & (F.abs(a_num + b_num - F.col("c_num")) <= F.lit(S.TOLERANCE))
    pick = lambda k: (F.when(before, F.col(f"x_{k}")).otherwise(F.col(f"y_{k}")), F.when(before, F.col(f"y_{k}")).otherwise(F.col(f"x_{k}")))
    return joined.where(ok).select(F.lit(S.RELATIONS[2]).alias("relation_type"), F.lit(1).alias("family"), F.array("c_pos", *pick("pos")).alias("positions"), F.array(*pick("id"), "c_id").alias("fact_ids"), *_bucket(F.col("c_entity_key"), F.col("c_year"), F.col("c_basis_key")))


def relationships(facts: DataFrame) -> DataFrame:
    """relation_type, fact_ids, order_key (pairs by entity and position, then sums by bucket and position).

    The deduplicated facts are read several times, so they are kept in the session's cache until the
    next call; what is lost with an executor is computed again.
    """
    spark = facts.sparkSession
    if spark in _HELD:
        _HELD.pop(spark).unpersist()
    deduped = _HELD[spark] = dedupe(facts, _READ).persist()
    where = ["family", "of_entity", "of_year", "of_basis"]
    places = deduped.select(F.lit(0).alias("family"), *_bucket(F.col("entity_key")), "pos").unionByName(deduped.select(F.lit(1).alias("family"), *_bucket(F.col("entity_key"), F.col("year"), F.col("basis_key")), "pos"))
    both = pairwise(deduped).unionByName(additive(deduped))
    keyed = both.join(places.groupBy(*where).agg(F.min("pos").alias("lead")), where, "left")
    return keyed.select("relation_type", "fact_ids", F.struct("family", "lead", "positions").alias("order_key"))


def with_evidence(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds evidence (a struct for each fact, in order) and a sentence of explanation."""
    each = relations.withColumn("__rel", F.xxhash64("relation_type", "fact_ids")).select("__rel", "relation_type", "fact_ids", "order_key", F.posexplode("fact_ids").alias("__n", "__id"))
    shown = facts.select(F.struct(F.col("id").alias("fact_id"), *EVIDENCE).alias("__fact"))
    got = each.join(shown, F.col("__id") == F.col("__fact.fact_id")).groupBy("__rel", "relation_type", "fact_ids", "order_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__fact"))), lambda x: x["__fact"]).alias("evidence"))
    one = lambda i, c: F.coalesce(F.get("evidence", i)[c], F.lit("none"))
    pair = F.format_string("%s of %s: '%s' and '%s' (%s, %s)", one(0, "metric"), one(0, "entity"), one(0, "value"), one(1, "value"), one(0, "period_label"), one(1, "period_label"))
    total = F.format_string("%s of %s: '%s' plus '%s' makes '%s'", one(2, "metric"), one(2, "entity"), one(0, "value"), one(1, "value"), one(2, "value"))
    return got.select("relation_type", "fact_ids", F.when(F.size("fact_ids") == 3, total).otherwise(pair).alias("explanation"), "evidence", "order_key")
