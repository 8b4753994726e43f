"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers ``floor(scale * x)``. Each block of vectors has, per dimension, its
postings sorted by value and cut into segments of equal quantised impact. A query walks
a dimension from the top where its weight is positive and from the bottom where it is
negative, so every impact above a dimension's least one is a gain. Segments of all
dimensions are processed by descending ``|weight| * impact``; each adds its quantised
(lower) impact to the accumulators of its rows. After a group of segments

* what a row can still gain is at most the sum of the next unprocessed impacts plus the
  quantisation widths, and
* the threshold is the larger of the best k-th exact score of earlier blocks and the
  k-th lower bound in this block.

Rows whose upper bound is below the threshold are proven out. Processing stops only when
few possible members are left (or all segments are done); those are rescored exactly.

Queries are packed in blocks and meet index blocks pairwise; the block results are merged
by a ranked window that limits each task's rows before the shuffle.

Defined results: vectors that are null or hold null, NaN or infinite components take no
part; shorter vectors count as padded with zeros, and an empty vector scores 0 with all; a query's
candidates are all rows of other ids (a repeated candidate row appears as often as it is
given, a repeated query row asks once, an id with several vectors asks for each of them
separately, a null id never asks and ranks last among ties);
scores beyond the range of a long are cut to it; an empty table gives no rows; extra
columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_pairs, stored

LEVELS = 16               # impact levels per dimension
INDEX_ROWS = 8192         # vectors per index block
QUERY_ROWS = 2048         # queries per query block
GROUP = 64                # segments between two proofs
FEW = 16                  # a share of one in so many rows (or 4 k) may be left to rescore
LONG = (1 << 63) - 1


def _integers(arrays, scale: int) -> np.ndarray:
    """Padded integer matrix; Python integers where 64 bits could overflow."""
    width = max((len(a) for a in arrays), default=0)
    x = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        x[i, :len(a)] = np.asarray(a, np.float64)
    x = np.floor(scale * x)
    if not x.size or np.abs(x).max() < 2.0 ** 29 / width ** 0.5:   # no sum of products above 2**58
        return x.astype(np.int64)
    return np.array([[int(e) for e in row] for row in x], object).reshape(x.shape)


class ImpactIndex:
    """Impact-ordered segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, null_id: np.ndarray, v: np.ndarray):
        self.ids, self.null_id, self.v = ids, null_id, v
        n, d = v.shape
        self.order = np.argsort(v, axis=0, kind="stable").T.copy() if v.dtype != object else None
        self.cuts, self.low, self.high = [], [], []
        if self.order is None:
            return
        for j in range(d):
            col = v[self.order[j], j]
            span = int(col[-1] - col[0]) + 1 if n else 1
            level = (col - col[0]) * LEVELS // span if n else col
            starts = np.flatnonzero(np.diff(level, prepend=-1))
            ends = np.append(starts[1:], n)
            self.cuts.append(np.stack([starts, ends], 1))
            self.low.append(col[starts])
            self.high.append(col[ends - 1])

    def _segments(self, q: np.ndarray):
        """(dimension, first, last, gain, next gain, width) by descending gain."""
        dim, first, last, gain, after, width = [], [], [], [], [], []
        for j in np.flatnonzero(q):
            w, cuts = abs(int(q[j])), self.cuts[j]
            if not len(cuts):
                continue
            if q[j] > 0:
                lo, hi, cuts = self.low[j][::-1], self.high[j][::-1], cuts[::-1]
            else:
                lo, hi = -self.high[j], -self.low[j]
            base = lo[-1]
            g, top = w * (lo - base), w * (hi - base)
            dim.append(np.full(len(cuts), j))
            first.append(cuts[:, 0])
            last.append(cuts[:, 1])
            gain.append(g)
            after.append(top)
            width.append(np.full(len(cuts), int((top - g).max())))
        if not dim:
            return None
        parts = [np.concatenate(x) for x in (dim, first, last, gain, after, width)]
        # descending upper impact; within a dimension that is the walk's own order
        order = np.argsort(-parts[4], kind="stable")
        return [p[order] for p in parts]

    def search(self, q_id: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) that contain the block's part of the top k of one query."""
        n = len(self.ids)
        width = max(self.v.shape[1], len(q))
        if self.order is None or q.dtype == object:
            v = np.zeros((n, width), object)
            v[:, :self.v.shape[1]] = self.v
            w = np.zeros(width, object)
            w[:len(q)] = q
            score = np.array([max(-LONG - 1, min(LONG, int(s))) for s in v.dot(w)], np.int64)
            return self._best(np.arange(n), score, q_id, k)
        d = min(self.v.shape[1], len(q))
        weights = np.zeros(self.v.shape[1], np.int64)
        weights[:d] = q[:d]
        segments = self._segments(weights)
        rows = np.arange(n)
        few = max(4 * k, n // FEW)
        if segments is not None:
            dim, first, last, gain, top, slack = segments
            base = sum(int(min(weights[j] * self.low[j][0], weights[j] * self.high[j][-1]))
                       for j in np.flatnonzero(weights))
            acc = np.full(n, base, np.int64)
            rest = np.zeros(len(weights), np.int64)     # next unprocessed impact per dimension
            np.maximum.at(rest, dim, top)
            error = int(slack[np.unique(dim, return_index=True)[1]].sum())
            own = (self.ids == q_id) & ~self.null_id
            acc[own] = np.iinfo(np.int64).min // 2
            for at in range(0, len(dim), GROUP):
                stop = min(len(dim), at + GROUP)
                for s in range(at, stop):
                    if gain[s]:
                        acc[self.order[dim[s], first[s]:last[s]]] += gain[s]
                rest[dim[at:stop]] = 0
                tail_dim, tail_top = dim[stop:], top[stop:]
                np.maximum.at(rest, tail_dim, tail_top)
                room = error + int(rest.sum())
                bound = int(np.partition(acc, n - k)[n - k]) if n > k else None
                if floor is not None:
                    bound = floor if bound is None else max(bound, floor)
                if bound is not None:
                    rows = np.flatnonzero(acc + room >= bound)
                    if len(rows) <= few:
                        break
        return self._best(rows, self.v[rows] @ weights, q_id, k)

    def _best(self, rows: np.ndarray, score: np.ndarray, q_id: int, k: int):
        keep = (self.ids[rows] != q_id) | self.null_id[rows]
        rows, score = rows[keep], score[keep]
        order = np.lexsort((self.ids[rows], self.null_id[rows], ~score))
        return rows[order[:k]], score[order[:k]]


def usable(col: str):
    finite = F.forall(F.col(col), lambda e: e.isNotNull() & ~F.isnan(e)
                      & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
          vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows of other ids."""
    # a null id travels as a flag: pandas would turn the ids of its batch into floats
    pick = [F.coalesce(F.col(vec_id), F.lit(0)).cast("long").alias("vec_id"),
            F.col(vec_id).isNull().alias("null_id"), F.col(embedding).alias("v")]
    rows = vectors.where(usable(embedding)).select(*pick)
    asks = queries.where(usable(embedding) & F.col(vec_id).isNotNull()).select(*pick).distinct()
    rows, asks = stored(rows, "rows"), stored(asks, "asks")
    n_rows, n_asks = rows.count(), asks.count()
    parts, ask_parts = max(1, -(-n_rows // INDEX_ROWS)), max(1, -(-n_asks // QUERY_ROWS))

    def in_blocks(frame: DataFrame, parts: int, size: int, build, schema: str) -> DataFrame:
        def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, rows_held = [], 0
            for batch in batches:
                held.append(batch)
                rows_held += len(batch)
                while rows_held >= 2 * size:
                    together = pd.concat(held, ignore_index=True)
                    yield build(together.iloc[:size])
                    held, rows_held = [together.iloc[size:]], rows_held - size
            if rows_held:
                yield build(pd.concat(held, ignore_index=True))

        return frame.repartition(parts).mapInPandas(chunks, schema)

    def index_block(pdf: pd.DataFrame) -> pd.DataFrame:
        index = ImpactIndex(pdf["vec_id"].to_numpy(np.int64), pdf["null_id"].to_numpy(bool),
                            _integers(list(pdf["v"]), scale))
        return pd.DataFrame({"index": [pickle.dumps(index.__dict__, protocol=5)]})

    def query_block(pdf: pd.DataFrame) -> pd.DataFrame:
        state = (pdf["vec_id"].to_numpy(np.int64), _integers(list(pdf["v"]), scale))
        return pd.DataFrame({"queries": [pickle.dumps(state, protocol=5)]})

    index = stored(in_blocks(rows, parts, INDEX_ROWS, index_block, "index binary")
                   .select(F.monotonically_increasing_id().alias("i"), "index"), "index")
    packed = stored(in_blocks(asks, ask_parts, QUERY_ROWS, query_block, "queries binary")
                    .select(F.monotonically_increasing_id().alias("j"), "queries"), "queries")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[tuple, int] = {}   # per query: k-th best exact score so far in this task
        for batch in batches:
            for blob, j, ask in zip(batch["index"], batch["j"], batch["queries"]):
                block = ImpactIndex.__new__(ImpactIndex)
                block.__dict__.update(pickle.loads(blob))
                q_ids, q_vecs = pickle.loads(ask)
                out = []
                for number, (q_id, q) in enumerate(zip(q_ids.tolist(), q_vecs)):
                    found, score = block.search(q_id, q, k, floors.get((j, number)))
                    if len(found) == k:
                        floors[j, number] = max(floors.get((j, number), -LONG - 1), int(score[-1]))
                    ask_id = (int(j) << 20) + number
                    out.append((np.full(len(found), q_id), np.full(len(found), ask_id),
                                block.ids[found], block.null_id[found], score))
                cols = [np.concatenate(c) for c in zip(*out)]
                ids = pd.Series(cols[2]).astype("Int64").mask(cols[3])
                yield pd.DataFrame({"query_id": cols[0], "ask": cols[1], "vec_id": ids, "score": cols[4]})

    best = (block_pairs(index, "i", parts, packed, "j", ask_parts).select("index", "j", "queries")
            .mapInPandas(answer, "query_id long, ask long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
