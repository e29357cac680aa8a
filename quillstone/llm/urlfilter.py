"""URL filter: rules on host and path, then a logistic regression on hashed character n-grams.

DataFrame and SQL functions only. The model is trained from a small labelled URL table (url,
blocked): n-grams are hashed into `buckets` counts and fitted, and later scored, with the DataFrame
API of Spark's own library, which stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, load

#: The rules, as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of an n-gram, buckets of the hash, most labelled rows, regularisation.
N = 3
BUCKETS = 1 << 12
LABELLED = 2000
PENALTY = 0.001


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does. Equal lengths: the earlier one."""
    best = sorted(rules, key=lambda r: -len(r[1]))
    pick = lambda i: reduce(lambda c, r: c.when(fits(r[1], host, path), r[i]), best, F)
    return (pick(1), pick(0)) if best else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams_of(host: Column, path: Column, n: int = N) -> Column:
    """The character n-grams of ^host and of path$, marked h or p; none for an empty URL."""

    def grams(text: Column, mark: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))
        return F.transform(places, lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))

    both = F.concat(grams(F.concat(F.lit("^"), host), "h"), grams(F.concat(path, F.lit("$")), "p"))
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(both)


def train(labelled: DataFrame, n: int = N, buckets: int = BUCKETS, most: int = LABELLED, penalty: float = PENALTY):
    """A function that adds the column score (log-odds of blocking) to rows with host and path, from a table of url and blocked.

    Copies of a url with one label are one row, weighted by their number. Of a larger table the rows
    of the smallest xxhash64 of the url are used (ties by url), at most half of `most` of each label
    and more where the other has fewer; that bounds the fit. Each label's weights are scaled to its
    number of rows in the whole table. Rows with a null label do not count. Without rows of both kinds the score
    is the constant of the only kind there is, or allows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    rows = labelled.where(F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("double").alias("label"))
    rows = rows.groupBy("url", "label").agg(F.count("*").cast("double").alias("weight"))
    sizes = {r["label"]: (r["n"], r["total"]) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).collect()}
    kinds = set(sizes)
    if len(kinds) < 2:
        return lambda df: df.withColumn("score", F.lit(5.0 if kinds == {1.0} else -5.0))
    taken = {k: min(n, max(most // 2, most - sizes[1.0 - k][0])) for k, (n, _) in sizes.items()}
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(n) for k, n in taken.items()]
    rows = checkpoint(reduce(DataFrame.unionByName, parts))
    drawn = {r["label"]: r["total"] for r in rows.groupBy("label").agg(F.sum("weight").alias("total")).collect()}
    scale = reduce(lambda c, k: c.when(F.col("label") == k, sizes[k][1] / drawn[k]), kinds, F)
    rows = rows.withColumn("weight", F.col("weight") * scale)
    hashing = HashingTF(numFeatures=buckets, inputCol="__grams", outputCol="__features")
    counted = hashing.transform(rows.withColumn("__grams", grams_of(host_of(F.col("url")), path_of(F.col("url")), n)))
    model = LogisticRegression(featuresCol="__features", maxIter=30, regParam=penalty, standardization=False, rawPredictionCol="__raw", weightCol="weight").fit(counted.select("label", "weight", "__features"))

    def score(df: DataFrame) -> DataFrame:
        found = model.transform(hashing.transform(df.withColumn("__grams", grams_of(F.col("host"), F.col("path"), n))))
        return found.withColumn("score", F.get(vector_to_array("__raw"), 1))

    return score


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, n: int = N, buckets: int = BUCKETS, most: int = LABELLED, penalty: float = PENALTY) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's log-odds of blocking) of every row.

    A rule's verdict stands; else a positive score blocks. labelled defaults to the URLs that a rule
    decides. A null url or one without :// has empty host and path and no n-grams, so the model's
    intercept judges it. Repeated rows are judged alike, an empty table gives no rows.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        labelled = rows.where(F.col("rule").isNotNull()).select("url", (F.col("ruled") == "block").alias("blocked"))
    rows = train(labelled, n, buckets, most, penalty)(rows)
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
