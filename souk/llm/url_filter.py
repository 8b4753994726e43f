"""URL filters: host and path rules first, then a list of canonical URLs.

The list is probed through a blocked Bloom filter (one 512-bit block per key, one bit in
each of its eight words). URLs that the filter passes go to an exact join with the list,
which removes its false positives; the others cannot be listed and never shuffle.

The filter is built by grouped bitwise sums and broadcast. Its size follows the list up
to ``MAX_BLOCKS`` blocks (32 MB); a longer list makes it pass more, the join still decides.

Defined results: a null URL, or one without ``://``, has an empty host and path; rules
need a path that starts with theirs, so an empty path fits only an empty rule path; of
equally long rules the one with the longer host wins; rows that repeat are judged each;
an empty table gives no rows; an empty list allows what no rule judges; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8                   # 64-bit words per block
KEYS_PER_BLOCK = 32         # 16 bits per key
MAX_BLOCKS = 1 << 19        # 32 MB
SEGMENT = 1 << 12           # blocks per collected row


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment and trailing slashes do not tell canonical URLs apart."""
    return F.concat(host, F.rtrim(path, F.lit("/")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``(verdict, host, path)`` that fits, or nulls."""
    best = F.array(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("h"),
                        F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules])
    top = F.array_max(best)
    return top["rule"], top["verdict"]


def _hashes(url: Column, n_blocks: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)), F.xxhash64(F.lit("bits"), url)


def build_filter(listed: DataFrame, n_listed: int) -> np.ndarray:
    """(blocks, 8) words of a blocked Bloom filter of the ``url`` column."""
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * KEYS_PER_BLOCK < n_listed:
        n_blocks *= 2
    block, bits = _hashes(F.col("url"), n_blocks)
    keyed = listed.select(block.alias("block"), bits.alias("bits"))
    words = keyed.groupBy("block").agg(*[
        F.expr(f"bit_or(shiftleft(1L, cast(shiftright(bits, {6 * i}) & 63 as int)))").alias(f"w{i}")
        for i in range(WORDS)])

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros((SEGMENT, WORDS), np.int64)
        part[pdf["block"] % SEGMENT] = pdf[[f"w{i}" for i in range(WORDS)]].to_numpy(np.int64)
        return pd.DataFrame({"segment": [int(pdf["block"].iloc[0]) // SEGMENT],
                             "data": [part.tobytes()]})

    rows = (words.withColumn("segment", F.floor(F.col("block") / SEGMENT))
            .groupBy("segment").applyInPandas(segment, "segment long, data binary").collect())
    out = np.zeros((max(n_blocks, SEGMENT), WORDS), np.int64)   # at most MAX_BLOCKS blocks
    for r in rows:
        out[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = \
            np.frombuffer(r["data"], np.int64).reshape(-1, WORDS)
    return out[:n_blocks]


def may_be_listed(url: Column, words, n_blocks: int) -> Column:
    """Bloom test of a canonical URL column against the broadcast filter."""

    @F.pandas_udf("boolean")
    def probe(block: pd.Series, bits: pd.Series) -> pd.Series:
        rows = words.value[block.to_numpy()].view(np.uint64)
        shifts = np.arange(WORDS, dtype=np.uint64) * np.uint64(6)
        bit = (bits.to_numpy(np.int64).view(np.uint64)[:, None] >> shifts) & np.uint64(63)
        return pd.Series(((rows >> bit) & np.uint64(1)).all(1))

    return probe(*_hashes(url, n_blocks))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame,
          url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict``: the rule's verdict, else block if listed."""
    spark = pages.sparkSession
    host, path = url_parts(url)
    seen = listed.select(canonical(*url_parts("url")).alias("url")).where(F.col("url") != "").distinct()
    seen = stored(seen, "listed")
    words = build_filter(seen, seen.count())
    shared = spark.sparkContext.broadcast(words)
    parted = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                           canonical(F.col("host"), F.col("path")).alias("canon"))
    probed = stored(judged.withColumn(
        "maybe", may_be_listed(F.col("canon"), shared, len(words)) & F.col("rule").isNull()), "probed")
    out = ["page_id", "host", "path", "rule"]
    clear = probed.where(~F.col("maybe")).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    exact = seen.select("url", F.lit("block").alias("found"))
    hits = (probed.where("maybe").join(exact, F.col("canon") == F.col("url"), "left")
            .select(*out, F.coalesce("found", F.lit("allow")).alias("verdict")))
    return clear.unionByName(hits)
