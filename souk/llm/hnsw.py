"""Embedding near-duplicates: HNSW graphs per shard, audited beams, exact verification.

* Usable vectors (no null, NaN or infinite component, not all zero) are collapsed to
  distinct ones and dealt evenly over shards; a task builds one small-world graph per
  shard, inserting nodes in batches with vectorised beam searches. A node that ends
  without an incoming edge gets one from a near neighbour, so all can be reached.
* Before a graph is stored, its search beam is audited: vectors placed at exactly the
  link cosine from sampled nodes must be led back to them. The beam doubles until the
  measured recall reaches ``recall`` (or covers the shard, where search is exhaustive).
* Every block of vectors queries every shard. A query whose whole beam consists of
  links is answered by the exact product with the shard, so large groups are not cut and
  a full beam needs no audit.
* Candidates are verified by cosine in double precision. A task returns, per vector,
  the number of links, and a spanning forest of the links; pairs are never emitted.

Defined results: vectors that take no part (see above; also empty arrays) have zero
links and are their own component; vectors of different dimension link with nothing
of another dimension; repeated rows link to each other (each row counts); a row with
a null vec_id takes part, but a component's id is its smallest non-null vec_id; an
empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, stored

NEIGHBOURS = 16           # links per node on upper layers, twice as many on the lowest
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDIT_QUERIES = 256       # planted queries per shard audit
QUERY_BLOCK = 4096        # vectors per query block
SHARD_ROWS = 50_000       # vectors per shard graph
LEAST_SHARDS = 4
EXPAND = 4                # beam entries expanded per step
BATCH = 512
NODE_CHUNK = 8192         # nodes compared at once with queries whose beam is full
SLACK = 1e-4              # single-precision margin before the double-precision check


class Graph:
    """A hierarchical navigable small-world graph over unit vectors of one shard."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1.0 - rng.random(n)) / np.log(NEIGHBOURS)).astype(int)
        order = np.argsort(-level, kind="stable")   # highest first: layers fill top-down
        self.back = order                           # graph position -> row of the shard
        self.v, level = self.v[order], level[order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if n else []
        self.links = [np.full((m, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32)
                      for k, m in enumerate(self.sizes)]
        self.beam = FIRST_BEAM
        at = 1
        while at < n:
            self._insert(at, min(n, at + min(at, BATCH)))
            at = min(n, at + min(at, BATCH))
        self._adopt()

    # ---- search -------------------------------------------------------------------

    def _search(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int,
                known: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes (id, similarity; -1 and -inf where fewer) for each query."""
        links, n = self.links[layer], max(known, 1)
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        done = np.ones((len(q), ef), bool)
        e = min(entry.shape[1], ef)
        ids[:, :e] = entry[:, :e]
        ok = ids >= 0
        sims[:, :e] = np.einsum("qd,qed->qe", q, self.v[np.maximum(ids[:, :e], 0)])
        sims[~ok] = -np.inf
        done[ok] = False
        seen = np.zeros((len(q), n), bool)
        r, c = np.nonzero(ok)
        seen[r, ids[r, c]] = True
        rows = np.arange(len(q))
        width = min(EXPAND, ef)
        while len(rows):
            open_sims = np.where(done[rows], -np.inf, sims[rows])
            pick = np.argpartition(-open_sims, width - 1, axis=1)[:, :width] \
                if ef > width else np.tile(np.arange(ef), (len(rows), 1))
            live = np.take_along_axis(open_sims, pick, 1) > -np.inf
            any_live = live.any(1)
            rows, pick, live = rows[any_live], pick[any_live], live[any_live]
            if not len(rows):
                break
            node = np.where(live, np.take_along_axis(ids[rows], pick, 1), -1)
            done[rows[:, None], pick] |= live
            near = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1)
            near = np.sort(near.reshape(len(rows), -1), axis=1)
            bad = near < 0
            bad[:, 1:] |= near[:, 1:] == near[:, :-1]
            bad |= seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(~bad)
            cand = near[r, c]
            seen[rows[r], cand] = True
            if not len(r):
                continue
            s = np.einsum("nd,nd->n", q[rows[r]], self.v[cand])
            worth = s > sims[rows[r]].min(1)
            r, cand, s = r[worth], cand[worth], s[worth]
            if not len(r):
                continue
            # pack the new candidates of each query to the left and merge with its beam
            counts = np.bincount(r, minlength=len(rows))
            slot = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            w = counts.max()
            new_ids = np.full((len(rows), w), -1, np.int64)
            new_sims = np.full((len(rows), w), -np.inf, np.float32)
            new_ids[r, slot], new_sims[r, slot] = cand, s
            all_sims = np.concatenate([sims[rows], new_sims], 1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            sims[rows] = np.take_along_axis(all_sims, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_ids], 1), top, 1)
            done[rows] = np.take_along_axis(
                np.concatenate([done[rows], new_ids < 0], 1), top, 1)
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def _descend(self, q: np.ndarray, to_layer: int, known: int) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int64)     # node 0 has the highest level
        for layer in range(len(self.sizes) - 1, to_layer, -1):
            entry, _ = self._search(q, entry, 8, layer, min(known, self.sizes[layer]))
        return entry

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.v)
        if ef >= n:
            sims = q @ self.v.T
            return np.tile(np.arange(n), (len(q), 1)), sims
        return self._search(q, self._descend(q, 0, n), ef, 0, n)

    # ---- construction -------------------------------------------------------------

    def _choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Diverse neighbours first (nearer to q than to any chosen one), then the nearest."""
        c = ids.shape[1]
        vec = self.v[np.maximum(ids, 0)]
        between = np.matmul(vec, vec.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for j in range(c):
            rival = np.where(chosen, between[:, j, :], -np.inf).max(1)
            chosen[:, j] = (ids[:, j] >= 0) & (rival < sims[:, j])
        rank = np.where(ids < 0, 4 * c, np.where(chosen, 0, c) + np.arange(c))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, pick, 1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out

    def _insert(self, lo: int, hi: int) -> None:
        q = self.v[lo:hi]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.sizes) - 1, -1, -1):
            size = self.sizes[layer]
            known = min(lo, size)
            ef = BUILD_BEAM if lo < size else 8
            ids, sims = self._search(q, entry, ef, layer, known)
            entry = ids[:, :8]
            new = min(hi, size) - lo                # nodes of this batch on this layer
            if new <= 0:
                continue
            mates = own[:new, :new]
            k = min(BUILD_BEAM, new)
            top = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(mates, top, 1)
            ids2 = np.concatenate([ids[:new], np.where(near > -np.inf, top + lo, -1)], 1)
            sims2 = np.concatenate([sims[:new], near], 1)
            best = np.argsort(-sims2, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids2, sims2 = np.take_along_axis(ids2, best, 1), np.take_along_axis(sims2, best, 1)
            m = self.links[layer].shape[1]
            mine = self._choose(q[:new], ids2, sims2, NEIGHBOURS)
            self.links[layer][lo:lo + new, :NEIGHBOURS] = mine
            # reciprocal links; a full list is chosen anew among old and new neighbours
            src, dst = np.repeat(np.arange(lo, lo + new), NEIGHBOURS), mine.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            node, first, count = np.unique(dst, return_index=True, return_counts=True)
            w = int(count.max()) if len(count) else 0
            for at in range(0, len(node), 256):
                some, f, c = node[at:at + 256], first[at:at + 256], count[at:at + 256]
                add = np.full((len(some), w), -1, np.int64)
                col = np.arange(w)
                fill = col[None, :] < c[:, None]
                add[fill] = src[(f[:, None] + col[None, :])[fill]]
                ids3 = np.concatenate([self.links[layer][some].astype(np.int64), add], 1)
                ids3 = np.sort(ids3, axis=1)
                ids3[:, 1:][ids3[:, 1:] == ids3[:, :-1]] = -1
                sims3 = np.einsum("nd,ncd->nc", self.v[some], self.v[np.maximum(ids3, 0)])
                sims3 = np.where((ids3 >= 0) & (ids3 != some[:, None]), sims3, -np.inf)
                best = np.argsort(-sims3, axis=1, kind="stable")[:, :m + NEIGHBOURS]
                ids3, sims3 = np.take_along_axis(ids3, best, 1), np.take_along_axis(sims3, best, 1)
                ids3 = np.where(sims3 > -np.inf, ids3, -1)
                self.links[layer][some] = self._choose(self.v[some], ids3, sims3, m)

    def _adopt(self) -> None:
        """An incoming edge on the lowest layer for every node that has none."""
        if len(self.v) < 2:
            return
        links = self.links[0]
        degree = np.bincount(links[links >= 0], minlength=len(self.v))
        for node in np.flatnonzero(degree == 0):
            near = links[node][links[node] >= 0]
            for parent in near[np.argsort(-(self.v[near] @ self.v[node]), kind="stable")]:
                row = links[parent]
                free = np.flatnonzero(row < 0)
                if not len(free):           # in place of the farthest that others lead to as well
                    spare = np.flatnonzero(degree[row] > 1)
                    free = spare[np.argsort(self.v[row[spare]] @ self.v[parent], kind="stable")]
                if len(free):
                    if row[free[0]] >= 0:
                        degree[row[free[0]]] -= 1
                    row[free[0]] = node
                    degree[node] += 1
                    break

    # ---- audit --------------------------------------------------------------------

    def audit(self, threshold: float, recall: float, seed: int = 11) -> float:
        """Widen ``beam`` until planted queries at the threshold find their node."""
        n, d = self.v.shape
        rng = np.random.default_rng(seed)
        pick = rng.choice(n, min(n, AUDIT_QUERIES), replace=False)
        base = self.v[pick]
        noise = rng.normal(size=base.shape).astype(np.float32)
        noise -= np.einsum("nd,nd->n", noise, base)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        side = np.sqrt(max(0.0, 1 - threshold ** 2))
        planted = (threshold * base + side * noise).astype(np.float32)
        while True:
            ids, sims = self.search(planted, self.beam)
            # found, or the beam is full of links: then the whole shard is compared
            got = ((ids == pick[:, None]).any(1)
                   | ((sims >= threshold - SLACK).all(1) & (ids >= 0).all(1)))
            measured = float(got.mean())
            if measured >= recall or self.beam >= n:
                return measured
            self.beam *= 2

    # ---- linked nodes -------------------------------------------------------------

    def linked(self, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query rows, node positions)`` of candidate links, and the query rows whose beam
        is full of links, which may have more."""
        ids, sims = self.search(q, self.beam)
        hit = (sims >= threshold - SLACK) & (ids >= 0)
        full = hit.all(1) & (ids.shape[1] < len(self.v))
        r, c = np.nonzero(hit & ~full[:, None])
        return r, ids[r, c], np.flatnonzero(full)


def mask_edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, their columns, columns, their columns)``: few edges that connect what the true
    entries of ``mask`` (rows x columns) connect. Least column numbers travel to and fro; in a
    dense mask they arrive after a few turns."""
    n = mask.shape[1]
    of_col = np.arange(n)
    for _ in range(4):
        of_row = np.where(mask, of_col[None, :], n).min(1)
        least = np.minimum(of_col, np.where(mask, of_row[:, None], n).min(0))
        if (least == of_col).all():
            rows, cols = np.flatnonzero(of_row < n), np.flatnonzero(of_col != np.arange(n))
            return rows, of_row[rows], cols, of_col[cols]
        of_col = least
    rows, cols = np.nonzero(mask)
    return rows, cols, np.empty(0, np.int64), np.empty(0, np.int64)


def _matrix(arrays, d: int) -> np.ndarray:
    out = np.array([a for a in arrays], np.float64)
    return out.reshape(len(arrays), d)


def usable(col: str):
    """SQL condition of vectors that can link with something."""
    x = F.col(col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e)
                      & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda e: e != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = 0.9, recall: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = stored(vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.when(usable(embedding), F.col(embedding)).alias("v")), "vectors")
    copies = rows.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    # ids follow the stored table, so they stay the same if a task is run again
    nodes = stored(copies, "distinct")
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "*",
                                F.size("v").alias("d")), "nodes")
    n = nodes.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // QUERY_BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        v = _matrix(pdf["v"], d)
        graph = Graph(v / np.linalg.norm(v, axis=1, keepdims=True))
        measured = graph.audit(threshold, recall)
        back = graph.back
        state = {"links": graph.links, "sizes": graph.sizes, "beam": graph.beam,
                 "v": v[back], "node": pdf["node"].to_numpy()[back],
                 "copies": pdf["copies"].to_numpy()[back], "recall": measured}
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "sd": [d],
                             "graph": [pickle.dumps(state, protocol=5)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        state = {"v": _matrix(pdf["v"], d), "node": pdf["node"].to_numpy()}
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bd": [d],
                             "queries": [pickle.dumps(state, protocol=5)]})

    deal = F.xxhash64("node")
    graphs = stored(nodes.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int"))
                    .groupBy("shard", "d").applyInPandas(build, "shard int, sd int, graph binary"),
                    "graphs")
    queries = stored(nodes.withColumn("block", F.pmod(deal, F.lit(blocks)).cast("int"))
                     .groupBy("block", "d").applyInPandas(pack, "block int, bd int, queries binary"),
                     "queries")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for graph, queries in zip(batch["graph"], batch["queries"]):
                yield _links_of(pickle.loads(graph), pickle.loads(queries), threshold)

    found = stored(block_pairs(graphs, "shard", shards, queries, "block", blocks)
                   .where(F.col("sd") == F.col("bd")).select("graph", "queries")
                   .mapInPandas(compare, "a long, links long, b long"), "found")
    links = found.where(F.col("links") > 0).groupBy(F.col("a").alias("node")) \
        .agg(F.sum("links").alias("links"))
    member = connected_components(found.where(F.col("b").isNotNull()))
    named = stored(nodes.join(links, "node", "left").join(member, "node", "left")
                   .select("node", "v", "least_id",
                           (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component", "node").alias("component")), "named")
    label = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "label")
    distinct = stored(named.join(label, "component").select("v", "n_links", "component_id"), "of")
    linked = rows.where(F.col("v").isNotNull()).join(distinct, "v") \
        .select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) edges that connect exactly what the given edges connect."""
    ids, at = np.unique(np.append(a, b), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        x, y = label[left], label[right]
        open_ = x != y
        if not open_.any():
            break
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child], ids[label[child]]


def _links_of(graph: dict, queries: dict, threshold: float) -> pd.DataFrame:
    """Links of one query block into one shard: counts per query, and their forest."""
    g = Graph.__new__(Graph)
    g.links, g.sizes, g.beam = graph["links"], graph["sizes"], graph["beam"]
    exact, node, copies = graph["v"], graph["node"], graph["copies"]
    exact = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    g.v = exact.astype(np.float32)
    q64 = queries["v"] / np.linalg.norm(queries["v"], axis=1, keepdims=True)
    q32, q_node = q64.astype(np.float32), queries["node"]
    n = len(node)
    step = int(max(16, min(BATCH, (1 << 25) // max(1, n))))
    by_node = np.argsort(node)
    at_node = by_node[np.minimum(np.searchsorted(node, q_node, sorter=by_node), n - 1)]
    itself = np.where(node[at_node] == q_node, at_node, -1)     # the query's own place in the shard
    count = np.zeros(len(q_node), np.int64)
    tree = (np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(q_node), step):
        r, c, full = g.linked(q32[at:at + step], threshold)
        r = r + at
        cos = np.concatenate([np.einsum("nd,nd->n", q64[r[i:i + 65536]], exact[c[i:i + 65536]])
                              for i in range(0, len(r), 65536)] or [np.empty(0)])
        ok = (cos >= threshold) & (q_node[r] != node[c])
        r, c = r[ok], c[ok]
        np.add.at(count, r, copies[c])
        edges = [(q_node[r], node[c])]
        full = full + at
        for lo in range(0, n if len(full) else 0, NODE_CHUNK):
            mask = q64[full] @ exact[lo:lo + NODE_CHUNK].T >= threshold
            own = itself[full] - lo
            inside = np.flatnonzero((own >= 0) & (own < mask.shape[1]))
            mask[inside, own[inside]] = False
            count[full] += mask @ copies[lo:lo + NODE_CHUNK]
            rows, to, cols, roots = mask_edges(mask)
            edges += [(q_node[full[rows]], node[lo + to]), (node[lo + cols], node[lo + roots])]
        tree = star_edges(*(np.concatenate([t, *e]) for t, e in zip(tree, zip(*edges))))
    some = np.flatnonzero(count)
    return pd.DataFrame({
        "a": np.append(q_node[some], tree[0]),
        "links": np.append(count[some], np.zeros(len(tree[0]), np.int64)),
        "b": pd.array([None] * len(some) + tree[1].tolist(), "Int64")})
