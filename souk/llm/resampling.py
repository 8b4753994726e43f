"""Target-distribution importance resampling over hashed word features.

* Features are all runs of 1 to ``ngrams`` consecutive words; a feature's bucket is its
  CRC-32 modulo ``buckets``. Texts are cut into features once; the bucket numbers are stored.
* A bucket's gain is the scaled log ratio of its smoothed shares in the target texts and in
  the documents. The gains are an array of ``buckets`` numbers, and a document's weight adds
  up the gains that its bucket numbers point at.
* A document's score is its weight plus Gumbel noise from a hash of its id, so the highest
  scores are a sample without replacement in proportion to the exponentiated weights.
* The cutoff of the ``n`` highest scores is found without sorting: jobs over the stored
  scores count exactly how many lie at or above a few thresholds, and the interval around
  the cutoff shrinks until one number is left. Ties at it are cut the same way over doc_id.
* Only selected rows are dealt into ranges of (score, doc_id), numbered within their range
  and moved up by the sizes of the ranges before. The others never move.

Defined results: a null or wordless text has no features and weight 0; a null id is hashed as
an empty one and comes last among ties; repeated rows are scored and drawn each, of equal
scores and ids at the cutoff those with fewest features are drawn; without target texts or
documents the smoothing alone decides; an empty table gives no rows; extra columns are never
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WAYS = 16                 # thresholds counted by one job, plus one


def words(text: str) -> Column:
    """The words of a text (null: none)."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return F.filter(F.coalesce(F.split(lowered, SEPARATORS), F.array().cast("array<string>")),
                    lambda w: w != "")


def features(found: Column, ngrams: int) -> Column:
    """All runs of 1 to ``ngrams`` words, joined by one space."""
    def runs(k: int) -> Column:
        if k == 1:
            return found
        starts = F.when(F.size(found) >= k, F.sequence(F.lit(1), F.size(found) - (k - 1))) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, k), " "))

    return F.concat(*[runs(k) for k in range(1, ngrams + 1)]) if ngrams > 1 else found


def bucketed(docs: DataFrame, keys: dict[str, str], text: str, ngrams: int, buckets: int) -> DataFrame:
    """``keys`` renamed, ``n_words`` and ``found``: the bucket number of each feature."""
    split = docs.select(*[F.col(v).alias(k) for k, v in keys.items()], words(text).alias("words"))
    numbers = F.transform(features(F.col("words"), ngrams),
                          lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return split.select(*keys, F.size("words").cast("long").alias("n_words"), numbers.alias("found"))


def bucket_counts(found: DataFrame) -> dict[int, int]:
    """Features per bucket over all rows; at most a row per bucket reaches the driver."""
    each = found.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r["bucket"]: r["n"] for r in each.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int, scale: float = 1000.0) -> list[int]:
    """Floored, scaled log ratio of the smoothed shares of every bucket, in doubles."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(scale * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
            for b in range(buckets)]


def noise(doc_id: Column, seed: int, scale: float = 1000.0) -> Column:
    """Floored, scaled Gumbel noise from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-scale) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
           target_text: str = "text", ngrams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    rows = stored(bucketed(docs, {"doc_id": doc_id}, text, ngrams, buckets), "buckets")
    aims = bucketed(target, {}, target_text, ngrams, buckets)
    table = gains(bucket_counts(rows), bucket_counts(aims), buckets)
    # one constant array; text is its shortest way into the plan
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda acc, b: acc + F.get(gain, b))
    weighed = rows.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"),
                          weight.alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def least_reaching(rows: DataFrame, value: Column, wanted: int, low: int, high: int) -> int:
    """The least integer of ``low`` to ``high`` with at least ``wanted`` rows whose ``value``
    is at most it, found by exact counts; ``high`` must be such a number."""
    while low < high:
        step = max(1, (high - low) // WAYS)
        marks = sorted({m for m in range(low + step - 1, high, step)} if step > 1 else set(range(low, high)))[:WAYS]
        counts = rows.agg(*[F.coalesce(F.sum((value <= m).cast("long")), F.lit(0)).alias(f"m{i}")
                            for i, m in enumerate(marks)]).first()
        for i, m in enumerate(marks):
            if counts[i] >= wanted:
                high = m
                break
            low = m + 1
    return low


def drawn(rows: DataFrame, wanted: int) -> Column | None:
    """Condition of the ``wanted`` highest scores, ties to smaller ids, and of rows with the
    last one's score and id; None if nothing is wanted."""
    if wanted <= 0:
        return None
    ends = rows.agg(F.min(-F.col("score")).alias("low"), F.max(-F.col("score")).alias("high")).first()
    cut = -least_reaching(rows, -F.col("score"), wanted, ends["low"], ends["high"])
    above, tied = F.col("score") > cut, F.col("score") == cut
    rest = wanted - rows.where(above).count()
    ids = rows.where(tied).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                               F.count("doc_id").alias("n")).first()
    if ids["n"] < rest:                 # all tied ids, and some of the null ones behind them
        return above | tied
    last = least_reaching(rows.where(tied), F.col("doc_id"), rest, ids["low"], ids["high"])
    return above | (tied & (F.col("doc_id") <= last))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` (of a stored table) numbered from 1 in the given order, range by range; their
    place in the table tells equal ones apart, so these spread over ranges, too."""
    order = [*order, F.col("at").asc()]
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    dealt = stored(placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))        # a row per range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stored(sizes.select("range", F.coalesce(before, F.lit(0)).alias("before")), "sizes")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (dealt.withColumn("inside", inside).join(sizes, "range")
            .withColumn(name, F.col("inside") + F.col("before")).drop("at", "range", "inside", "before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20,
             ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, text: str = "text",
             doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null where a
    document is not drawn."""
    rows = stored(scored(docs, target, text, doc_id, target_text, ngrams, buckets, seed), "scores")
    open_ = F.col("n_words") >= least_words
    wanted = rows.where(open_).count() * percent // 100
    none = F.lit(None).cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    cut = drawn(rows.where(open_), wanted)
    if cut is None:
        return rows.select(*out, none.alias("rank"))
    inside = F.coalesce(open_ & cut, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    place = F.col("rank").cast("long")
    # equal rows at the cutoff may be more than are wanted
    taken = ranked(rows.where(inside).select(*out), order).select(
        *out, F.when(place <= wanted, place).alias("rank"))
    return taken.unionByName(rows.where(~inside).select(*out, none.alias("rank")))
