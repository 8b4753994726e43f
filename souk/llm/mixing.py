"""Mixing sources to target weights by Pareto order sampling.

Targets: all sizes together are shared by source weight; a source's target stops at
``cap`` times its size and the excess is shared again by weight until none is above.

Copies: a document's expected copies ``e`` are proportional to its own weight (one, unless
``doc_weight`` names a column), at most ``cap``, and such that the words expected of a source are its
target. ``floor(e)`` whole copies are certain and the fraction is the inclusion probability
``p`` of one more. Pareto order sampling ranks a source's documents by
``(u / (1 - u)) / (p / (1 - p))``, the odds of a random number over the odds of
inclusion, and takes them in that order up to the words still wanted. The random number
is a hash of the row, so reruns agree on any layout.

The cut per source is found without ordering a source in one task: the rank is a 52-bit
number, and two rounds of grouped sums over its leading bits narrow the cut to one cell
of 2**30 ranks; only that cell's rows are ordered. The cut falls where the taken words
come nearest to the target, so a source misses it by half a document at most.

Equal rows are grouped before ranking and numbered within the group, so repeated rows
are drawn one by one. Sources are ranked by code point with null last; their weights
cycle through ``weights``. All tables but the documents' keys have a row per source.

Defined results: null and empty texts have size 0 and are never drawn for words (they get
the certain copies, which take none); a source without words has target 0; the null
source is a source of its own; a null document weight is one, a negative or NaN one is
zero; an empty table gives no rows; extra columns are ignored
by ``mix_plan`` and carried by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORDS = r"[^\x20\x09-\x0D]+"
PART = 10_000             # repeats of one row that are written together
BITS, FIRST, SECOND = 52, 41, 30    # rank bits; bits inside a cell of either round


def n_words(col: str):
    """Number of words of a text (null: 0), in the JVM."""
    marked = F.regexp_replace(F.col(col), WORDS, "x")
    return F.coalesce(F.length(marked) - F.length(F.translate(marked, "x", "")),
                      F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` for every source of ``source, size``."""
    by_source = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                 .withColumn("null", F.col("source").isNull()))
    # position by code point: ranges of sources, counted, then numbered inside each range
    ranged = stored(by_source.repartitionByRange("null", "source")
                    .withColumn("range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("range", F.coalesce(before, F.lit(0)).alias("before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("range").orderBy("null", "source"))
    ranked = ranged.withColumn("inside", inside).join(counts, "range")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    place = F.pmod(F.col("before") + F.col("inside") - 1, F.lit(len(weights))).cast("int") + 1
    weighed = stored(ranked.select("source", "source_size",
                                   F.element_at(cycle, place).alias("weight")), "weighed")
    return _shared(weighed, F.col("source_size") * cap)


def _shared(weighed: DataFrame, limit: Column) -> DataFrame:
    """``weighed`` with ``target``: all words shared by weight, no source above its limit.

    Sources reach their limits in the order of limit / weight. With the first of that order
    at their limits, the others share what is left; the first source that its own share does
    not lift above its limit tells the level of all. Running sums are taken range by range.
    """
    weight, ratio = F.col("weight"), F.col("ratio")
    every = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"),
                        F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    order = ["ratio", "null", "source"]
    ranged = stored(weighed.select("source", "weight", F.col("source").isNull().alias("null"), limit.alias("limit"),
                                   F.when(weight > 0, limit / weight).otherwise(float("inf")).alias("ratio"))
                    .repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "limits")
    sums = ranged.groupBy("range").agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)       # a row per range
    sums = sums.select("range", F.sum("limits").over(earlier).alias("limits_before"),
                       F.sum("weights").over(earlier).alias("weights_before"))
    ahead = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(one: str, many: str) -> Column:
        return F.coalesce(F.sum(one).over(ahead), F.lit(0)) + F.coalesce(many, F.lit(0))

    steps = ranged.join(sums, "range").select(
        *order, "limit", "weight", (F.lit(every["t"]) - before("limit", "limits_before")).alias("open"),
        (F.lit(every["w"]) - before("weight", "weights_before")).alias("open_weight"))
    level = F.when(F.col("open_weight") > 0, F.col("open") / F.col("open_weight"))
    below = ~(F.col("limit").cast("double") < weight * level)
    found = steps.agg(F.min_by(F.when(below, level), F.when(below, F.struct(*order))).alias("level"),
                      F.max(F.when(weight > 0, ratio)).alias("top")).first()
    share = found["level"] if found["level"] is not None else found["top"] or 0.0     # else all are at their limits
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), limit.cast("double")))


def text_hash(col: str):
    return F.coalesce(F.md5(F.col(col)), F.lit("null"))


def _weight(doc_weight: str | None) -> Column:
    w = F.lit(1.0) if doc_weight is None else F.coalesce(F.col(doc_weight).cast("double"), F.lit(1.0))
    return F.when(F.isnan(w) | (w < 0), 0.0).otherwise(w)


def _keyed(docs: DataFrame, text: str, doc_id: str, source: str, doc_weight: str | None) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       n_words(text).alias("size"), text_hash(text).alias("h"),
                       _weight(doc_weight).alias("w"))


def _levels(items: DataFrame, targets: DataFrame, cap: int, even: bool) -> DataFrame:
    """``targets`` with ``level``: copies per unit of weight that bring the target's words.

    Documents at the cap leave and the others share the rest, as sources do; with even
    weights the level is plainly target over size, which is never above the cap.
    """
    size = F.col("source_size")
    if even:
        return targets.withColumn("level", F.when(size > 0, F.col("target") / size).otherwise(0.0))
    levels = targets.withColumn("level", F.lit(0.0))
    while True:
        words = (F.col("i.size") * F.col("i.m")).cast("double")
        full = F.col("t.level") * F.col("i.w") >= cap
        sums = (items.alias("i").join(levels.alias("t"), F.col("i.source").eqNullSafe(F.col("t.source")))
                .groupBy(F.col("t.source").alias("s")).agg(
                    F.coalesce(F.sum(F.when(full, words * cap)), F.lit(0.0)).alias("gone"),
                    F.coalesce(F.sum(F.when(~full, words * F.col("i.w"))), F.lit(0.0)).alias("open")))
        level = F.when(F.col("open") > 0, F.greatest("level", (F.col("target") - F.col("gone")) / F.col("open"))) \
            .otherwise(F.col("level"))
        after = stored(levels.join(sums, F.col("source").eqNullSafe(F.col("s")))
                       .select("source", "source_size", "weight", "target", level.alias("level"),
                               (level > F.col("level") * (1 + 1e-12)).alias("moved")), "levels")
        levels = after.drop("moved")
        if not after.where("moved").take(1):
            return levels


def _rank(c: dict[str, Column], seed: int, cap: int) -> tuple[Column, Column]:
    """Certain copies and Pareto rank (null: no further copy) of rows with the columns ``c``."""
    expected = F.least(F.lit(float(cap)), c["level"] * c["w"])
    p = expected - F.floor(expected)
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(c["doc_id"].cast("string"), F.lit("")),
                               c["h"], c["copy"].cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << BITS)
    odds = (u / (1 - u)) / (p / (1 - p))
    place = F.when(p > 0, F.floor(odds / (1 + odds) * float(1 << BITS))).cast("long")
    return F.floor(expected), place


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _counted(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """``rows`` once per number from ``first`` to ``last``, in parts of ``PART`` numbers: one row
    that stands for a third of all is written by many tasks."""
    bounds = rows.withColumns({"__from": first, "__to": last})
    many = F.col("__to") - F.col("__from") >= PART
    parts = (bounds.where(many).withColumn("__from", F.explode(F.sequence("__from", "__to", F.lit(PART).cast("long"))))
             .withColumn("__to", F.least(F.col("__to"), F.col("__from") + (PART - 1)))
             .repartition("__from", *[f"`{c}`" for c in rows.columns if c in ("h", "__souk_h")]))
    return (bounds.where(~many).unionByName(parts)
            .withColumn(name, F.explode(F.sequence("__from", "__to"))).drop("__from", "__to"))


def _numbered(items: DataFrame) -> DataFrame:
    """One row per document row: equal rows are told apart by ``copy``."""
    return _counted(items, F.lit(1).cast("long"), F.col("m"), "copy").drop("m")


def _cuts(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple, cap: int, seed: int,
          doc_weight: str | None) -> tuple[DataFrame, DataFrame]:
    """The grouped rows, and per source all that decides about one of its rows: ``source,
    source_size, target, level, cell, end`` (ranks below the cell are in, and those of the
    cell up to the row ``end``)."""
    # equal rows are one group with a count; no row of a hot group moves by itself
    items = stored(_keyed(docs, text, doc_id, source, doc_weight).groupBy("doc_id", "source", "size", "h", "w")
                   .agg(F.count(F.lit(1)).alias("m")), "items")
    targets = stored(source_targets(
        items.select("source", (F.col("size") * F.col("m")).alias("size")), weights, cap), "targets")
    targets = stored(_levels(items, targets, cap, doc_weight is None), "targets")
    both = _numbered(items).alias("r").join(targets.alias("t"), _same_source("r", "t"))
    whole, place = _rank({k: F.col(k) for k in ("level", "w", "doc_id", "h", "copy")}, seed, cap)
    ranked = stored(both.select("r.doc_id", "r.source", "size", "h", "copy", "target",
                                whole.alias("whole"), place.alias("place")), "ranked")
    certain = ranked.groupBy("source").agg(F.first("target").alias("target"),
                                           F.sum(F.col("size") * F.col("whole")).alias("sure"))
    wanted = stored(certain.select("source", (F.col("target") - F.col("sure")).alias("wanted")), "wanted")
    drawn = ranked.where((F.col("size") > 0) & F.col("place").isNotNull()) \
        .select("source", "size", "place", "doc_id", "h", "copy")
    # narrow the cut: a source's cell in which the running sum passes the wanted words
    cut = wanted.select("source", "wanted", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("base"))
    shift = BITS + 1
    for bits in (FIRST, SECOND):
        cut = _narrow(drawn, cut, shift, bits)
        shift = bits
    last = drawn.alias("d").join(cut.alias("c"), _in_cell(shift))
    order = Window.partitionBy("d.source").orderBy("place", "doc_id", "h", "copy")
    running = F.col("c.base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = last.select("d.source", "place", "doc_id", "h", "copy", "c.wanted", "c.base",
                       running.alias("sum"))
    # the end nearest to the wanted words; taking nothing of the cell is an end as well
    ends = ends.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("sum") - F.col("wanted")).alias("miss"), "place", "doc_id", "h", "copy"))
        .alias("end"), F.min(F.abs(F.col("base") - F.col("wanted"))).alias("none"))
    end = F.when(F.col("end.miss") < F.col("none"), F.struct("end.place", "end.doc_id", "end.h", "end.copy"))
    stop = cut.alias("c").join(ends.alias("e"), _same_source("c", "e"), "left") \
        .select("c.source", "cell", end.alias("end"))
    cuts = targets.alias("t").join(stop.alias("s"), _same_source("t", "s"), "left") \
        .select("t.source", "source_size", "target", "level", "cell", "end")
    return items, stored(cuts, "cuts")


def _with_copies(rows: DataFrame, cuts: DataFrame, seed: int, cap: int, prefix: str = "") -> DataFrame:
    """``rows`` with ``{prefix}source_size, {prefix}target, {prefix}copies``; the row's own
    ``doc_id, source, size, h, copy, w`` bear the prefix, too. ``cuts`` has a row per source."""
    named = cuts.select(*[F.col(c).alias(f"__cut_{c}") for c in cuts.columns])
    key = {k: F.col(prefix + k) for k in ("doc_id", "source", "size", "h", "copy", "w")}
    whole, place = _rank(key | {"level": F.col("__cut_level")}, seed, cap)
    at = F.struct(place.alias("place"), key["doc_id"].alias("doc_id"), key["h"].alias("h"), key["copy"].alias("copy"))
    more = (place.isNotNull() & (key["size"] > 0)
            & ((F.shiftright(place, SECOND) < F.col("__cut_cell"))
               | (F.col("__cut_end").isNotNull() & (at <= F.col("__cut_end")))))
    return rows.join(named, key["source"].eqNullSafe(F.col("__cut_source"))).select(
        *[F.col(f"`{c}`") for c in rows.columns], F.col("__cut_source_size").alias(prefix + "source_size"),
        F.col("__cut_target").alias(prefix + "target"),
        (whole + F.coalesce(more, F.lit(False)).cast("long")).alias(prefix + "copies"))


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
             weights: tuple = (1, 2, 3), cap: int = 3, seed: int = 42,
             doc_weight: str | None = None) -> DataFrame:
    """One row per document row: ``doc_id, source, size, h, w, copy, source_size, target,
    copies`` (``h``: hash of the text; ``copy``: number among equal rows)."""
    items, cuts = _cuts(docs, text, doc_id, source, weights, cap, seed, doc_weight)
    return _with_copies(_numbered(items), cuts, seed, cap)


def _in_cell(shift: int):
    return F.col("d.source").eqNullSafe(F.col("c.source")) \
        & (F.shiftright("d.place", shift) == F.col("c.cell"))


def _narrow(drawn: DataFrame, cut: DataFrame, shift: int, bits: int) -> DataFrame:
    """Cells of ``bits``-bit ranks inside the current cells (of ``shift`` bits)."""
    inside = drawn.alias("d").join(cut.alias("c"), _in_cell(shift))
    cells = (inside.groupBy("d.source", F.shiftright("d.place", bits).alias("cell"))
             .agg(F.sum("size").alias("words"), F.first("c.wanted").alias("wanted"),
                  F.first("c.base").alias("base")))
    order = Window.partitionBy("source").orderBy("cell")
    until = F.col("base") + F.sum("words").over(order)
    cells = cells.withColumn("until", until)
    first = cells.groupBy("source", "wanted").agg(
        F.min(F.when(F.col("until") >= F.col("wanted"),
                     F.struct("cell", (F.col("until") - F.col("words")).alias("base")))).alias("hit"),
        F.max(F.struct("cell", F.col("until").alias("until"))).alias("end"))
    # if all words together stay below, the cut is behind the last cell
    return stored(first.select("source", "wanted",
                               F.coalesce("hit.cell", F.col("end.cell") + 1).alias("cell"),
                               F.coalesce("hit.base", "end.until").cast("double").alias("base")), "cut")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    source: str = "source", weights: tuple = (1, 2, 3), cap: int = 3,
                    seed: int = 42, doc_weight: str | None = None) -> DataFrame:
    """The mix itself: each document row as often as it is taken, with its columns.

    The copies of a row follow from the row and its source's cut, so texts stay where they
    are; only rows that are repeated are brought together by id, source and text. They are
    numbered in the order of their other columns, so each keeps its own values.
    """
    names = docs.columns
    items, cuts = _cuts(docs, text, doc_id, source, weights, cap, seed, doc_weight)
    repeated = stored(items.where(F.col("m") > 1), "repeated")
    keys = ["doc_id", "source", "size", "h", "w"]
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{doc_id}`").alias("__souk_doc_id"),
                      F.col(f"`{source}`").alias("__souk_source"), n_words(text).alias("__souk_size"),
                      text_hash(text).alias("__souk_h"), _weight(doc_weight).alias("__souk_w"),
                      F.lit(1).cast("long").alias("__souk_copy"))
    other = repeated.select(*[F.col(k).alias(f"__many_{k}") for k in keys])
    same = [F.col(f"__souk_{k}").eqNullSafe(F.col(f"__many_{k}")) for k in keys]
    plain = _with_copies(own.join(other, same, "left_anti"), cuts, seed, cap, "__souk_")
    own_keys, columns = [f"__souk_{k}" for k in keys], [F.col(f"`{c}`") for c in names]
    alike = (own.join(other, same, "left_semi").groupBy(*own_keys, *columns)
             .agg(F.count(F.lit(1)).alias("__souk_m")))
    order = Window.partitionBy(*own_keys).orderBy(
        F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    last = F.sum("__souk_m").over(order.rowsBetween(Window.unboundedPreceding, 0))
    alike = stored(alike.withColumn("__souk_last", last), "alike")
    numbered = _counted(alike, F.col("__souk_last") - F.col("__souk_m") + 1, F.col("__souk_last"), "__souk_copy")
    many = _with_copies(numbered, cuts, seed, cap, "__souk_").select(*columns, "__souk_copies")
    both = plain.select(*columns, "__souk_copies").unionByName(many)
    times = F.sequence(F.lit(1).cast("long"), F.col("__souk_copies"))
    return (both.where(F.col("__souk_copies") > 0).withColumn("__souk_n", F.explode(times))
            .select(*columns))
