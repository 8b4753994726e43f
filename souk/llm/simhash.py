"""SimHash near-duplicate detection by bit-sliced comparison.

1. A fingerprint per text: majority of the XXH64 bits over its word shingles.
2. Equal fingerprints collapse to one node each (a grouped minimum).
3. Candidate cells: with ``k`` bit blocks and radius ``r``, two fingerprints within
   ``r`` bits agree on at least ``k - r`` blocks, so each of the C(k, r) choices of
   blocks groups fingerprints by the kept bits. ``k`` follows the number of
   distinct fingerprints, so cells stay small at any size; the answer does not
   depend on it. Cells larger than ``CELL_ROWS`` are split into chunk pairs.
4. In a cell the fingerprints are stored as vertical bit planes. Distances to 64
   rows at a time are counted by carry-save full adders on machine words, and a
   word is abandoned as soon as all its counters exceed the radius.
5. A task returns only a spanning forest of the links it found; components are
   contracted with a distributed star algorithm.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle hash the whole word sequence; rows
that repeat a doc_id are separate nodes that meet through their fingerprints;
null doc_ids are ignored by minima (a component of null ids has a null id); an
empty table gives no rows; extra columns are never touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, slices, stored

SEED = 42
CELL_ROWS = 8192          # rows of one chunk of a large cell
PACK_ROWS = 4096          # small cells are compared together up to this many rows
HASH_CHUNK = 1 << 16      # shingle hashes unpacked to bits at once


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of each word shingle of a text (repeats included), in parts."""
    import xxhash

    digest, join, words = xxhash.xxh64_intdigest, b" ".join, []
    hashed = False
    for part in slices((text or "").encode("utf-8", "replace").lower()):
        words += part.split()
        if len(words) >= shingle:
            grams = zip(*(words[i:] for i in range(shingle)))
            yield np.fromiter((digest(join(g), seed) for g in grams), np.uint64,
                              len(words) - shingle + 1)
            words, hashed = words[len(words) - shingle + 1:], True
    if words and not hashed:
        yield np.array([digest(join(words), seed)], np.uint64)


def simhash64(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit majority fingerprint; a bit is set if in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, seed):
        n += len(h)
        for i in range(0, len(h), HASH_CHUNK):
            part = h[i:i + HASH_CHUNK]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text_col: str, shingle: int = 3, seed: int = SEED):
    """Arrow UDF column: the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        values = np.fromiter((simhash64(t, shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return fingerprints(F.col(text_col))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) vertical planes: bit j of word w of plane b is bit b of row 64w+j."""
    n = len(fps)
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def _count(planes_at, masks_at, lo: int, hi: int, counter: list, over: np.ndarray) -> np.ndarray:
    """Add planes lo..hi (an even number) of differing bits to the vertical counters.

    Two planes and the lowest counter go through one full adder; its carry ripples
    through the higher counters and out into ``over``.
    """
    for b in range(lo, hi, 2):
        x = planes_at(b) ^ masks_at(b)
        y = planes_at(b + 1) ^ masks_at(b + 1)
        if not counter:
            over |= x | y
            continue
        t = counter[0] ^ x
        carry = (counter[0] & x) | (t & y)
        counter[0] = t ^ y
        for i in range(1, len(counter)):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
    return over


def hits_within(fps: np.ndarray, radius: int, queries: np.ndarray,
                planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, word index, 64-bit hit mask) of rows within ``radius`` bits."""
    n, words = len(fps), planes.shape[1]
    m = max(1, math.ceil(math.log2(radius + 1))) if radius else 0
    start = (1 << m) - 1 - radius       # counters start here, so radius + 1 overflows
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1),
                     full, np.uint64(0))
    over = np.zeros((len(queries), words), np.uint64)
    if n % 64:
        over[:, -1] = full << np.uint64(n % 64)
    counter = [np.full(over.shape, full if start >> i & 1 else 0, np.uint64) for i in range(m)]
    dense = 16
    over = _count(lambda b: planes[b][None, :], lambda b: masks[:, b][:, None], 0, dense,
                  counter, over)
    q, w = np.nonzero(over != full)     # abandoned words drop out here and below
    counter, over = [c[q, w] for c in counter], over[q, w]
    for lo in range(dense, 64, 8):
        over = _count(lambda b: planes[b][w], lambda b: masks[q, b], lo, lo + 8, counter, over)
        alive = over != full
        if not alive.all():
            q, w, over = q[alive], w[alive], over[alive]
            counter = [c[alive] for c in counter]
    return q, w, ~over


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest (child row, root row) of the links among distinct fingerprints."""
    n = len(fps)
    planes, label = bit_planes(fps), np.arange(n)
    step = max(16, (1 << 18) // max(1, planes.shape[1]))
    for at in range(0, n, step):
        q, w, mask = hits_within(fps, radius, fps[at:at + step], planes)
        own = w == (q + at) // 64
        mask = np.where(own, mask & ~(np.uint64(1) << ((q + at) % 64).astype(np.uint64)), mask)
        keep = mask != 0
        q, w, mask = q[keep], w[keep], mask[keep]
        bounds = np.flatnonzero(np.diff(q, prepend=-1))
        for i, lo in enumerate(bounds):
            hi = bounds[i + 1] if i + 1 < len(bounds) else len(q)
            bits = np.unpackbits(mask[lo:hi].view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            r, c = np.nonzero(bits)
            rows = np.append(w[lo:hi][r] * 64 + c, q[lo] + at)
            found = np.unique(label[rows])
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    child = np.flatnonzero(label != np.arange(n))
    return [(int(i), int(label[i])) for i in child]


def blocks_for(n_distinct: int, radius: int) -> int:
    """Number of bit blocks so that a cell of evenly spread fingerprints has <= 64 rows."""
    k = radius + 1
    while k < 16 and n_distinct > 64 * 2 ** (64 * (k - radius) / k):
        k += 1
    return k


def cell_masks(k: int, radius: int) -> list[int]:
    """Bit masks (as signed longs) of the kept blocks, one for each choice of blocks."""
    edges = [round(64 * i / k) for i in range(k + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(k)]
    masks = [sum(block[i] for i in kept) for kept in combinations(range(k), k - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_forest(nodes: DataFrame, n_nodes: int, radius: int) -> DataFrame:
    """``(a, b)`` fingerprint links: a spanning forest per cell of ``nodes.fp``."""
    masks = cell_masks(blocks_for(n_nodes, radius), radius)
    cells = nodes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask")) \
        .select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = stored(cells.groupBy("t", "key").count().where(F.col("count") > CELL_ROWS)
                   .select("t", "key", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("chunks")),
                   "cells")
    i = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != i)
    dealt = (cells.join(large, ["t", "key"], "left")
             .withColumn("j", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1)))
                                        .otherwise(others)))
             .select("fp", "t", "key",
                     F.when(F.col("j") < 0, F.lit(0)).otherwise(F.least(i, F.col("j"))).alias("lo"),
                     F.when(F.col("j") < 0, F.lit(0)).otherwise(F.greatest(i, F.col("j"))).alias("hi")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush(parts):
            # in the order of longs, as components take their least: links point at it at once
            fps = np.unique(np.concatenate(parts)).view(np.uint64)
            pairs = forest(fps, radius)
            return pd.DataFrame({"a": fps[[p[0] for p in pairs]].view(np.int64),
                                 "b": fps[[p[1] for p in pairs]].view(np.int64)})

        current, key = [], None     # the cell being read, complete cells in held
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[c].to_numpy() for c in ("t", "key", "lo", "hi")]
            change = np.zeros(len(batch), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            fps = batch["fp"].to_numpy(np.int64)
            starts = np.append(np.flatnonzero(change), len(fps))
            lo = 0
            for end in starts:
                head = tuple(c[lo] for c in cols)
                if key is not None and head != key:
                    n = sum(map(len, current))
                    if n > 1:
                        if size + n > PACK_ROWS and held:
                            yield flush(held)
                            held, size = [], 0
                        held += current
                        size += n
                    current = []
                key = head
                current.append(fps[lo:end])
                lo = end
        if sum(map(len, current)) > 1:
            if size + sum(map(len, current)) > PACK_ROWS and held:
                yield flush(held)
                held = []
            held += current
        if held:
            yield flush(held)

    keys = ["t", "key", "lo", "hi"]
    return (dealt.repartition(*keys).sortWithinPartitions(*keys)
            .mapInPandas(compare, "a long, b long"))


def with_component(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``, a stored table of distinct ``fp``, with their component's root fingerprint."""
    member = connected_components(link_forest(nodes, nodes.count(), radius)) \
        .select(F.col("node").alias("fp"), "component")
    return nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def components(prints: DataFrame, doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """``(fp, component, component_id)``: a component's root fingerprint and its smallest
    ``doc_id``, linking fingerprints at ``radius`` bits or fewer.

    ``prints`` is a stored table with ``fp`` (signed long) and the id column.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "nodes")
    named = stored(with_component(nodes, radius), "named")
    label = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "label")
    return stored(named.join(label, "component").select("fp", "component", "component_id"),
                  "component_of")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document."""
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"),
                                fingerprint_column(text, shingle).alias("fp")), "prints")
    return (prints.join(components(prints, "doc_id", radius), "fp")
            .select("doc_id", "fp", "component_id"))


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  shingle: int = 3, radius: int = 3) -> DataFrame:
    """Keep one row of each component: the smallest doc_id (null ids last)."""
    names = docs.columns
    held = stored(docs.select(*[F.col(f"`{c}`") for c in names],
                              fingerprint_column(text, shingle).alias("__souk_fp"),
                              F.monotonically_increasing_id().alias("__souk_row")), "docs_fp")
    row = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("doc_id"), F.col("__souk_row").alias("row"))
    nodes = stored(held.groupBy(F.col("__souk_fp").alias("fp")).agg(F.min(row).alias("k")), "nodes")
    # nearly every row is kept, so the key set is never a small side to broadcast
    keep = stored(with_component(nodes, radius).groupBy("component").agg(F.min("k").alias("k"))
                  .select(F.col("k.row").alias("__souk_row")), "keep")
    return held.join(keep.hint("merge"), "__souk_row", "left_semi").select(*[F.col(f"`{c}`") for c in names])
