"""Vector code compression: per-part codebooks, nearest entries found by LAESA pivots.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts`` equal parts
and each part is replaced by the number of its nearest codebook entry.

* Every part position has ``pivots`` fixed points, chosen farthest first among its first
  codebook. The squared distance of every part to them is computed once and stored.
* The entries move from round to round, but only the few distances between pivots and
  entries are computed anew. By the triangle inequality, the largest difference between a
  part's and an entry's distance to a pivot is a lower bound of their own distance.
* A part takes its entries in ascending order of the bound, evaluates them exactly in
  integers, and stops at the first bound above its best distance. Bounds are lowered by
  more than their rounding error, so ties always reach the exact evaluation.
* A round's sums and counts per (position, entry) are added up in each task first; only
  they are shuffled, and only the codebooks (``entries`` times the dimension) reach the
  driver.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped;
shorter vectors count as padded with zeros to the longest, and the longest to a multiple of
``parts``; with fewer vectors than ``entries`` the codebooks are as short; of rows that share
the last starting id the least vectors start a codebook, a null id comes last; components
beyond ``LIMIT`` either way are cut to it, so that all sums are exact; repeated rows are
coded each; null labels make one group; an empty table gives no rows; extra columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

PIVOTS = 4                # fixed points per part position
SAFETY = 1e-9             # relative rounding error of a bound, generously
LIMIT = 1 << 26           # components are cut to this, either way
STEP_ROWS = 8192          # parts whose bounds are held at once


def usable(col: str):
    """SQL condition of vectors whose components are all finite."""
    return F.coalesce(F.forall(F.col(col), lambda e: e.isNotNull() & ~F.isnan(e)
                               & (F.abs(e.cast("double")) < F.lit(float("inf")))), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of ``a`` and all rows of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def choose_pivots(book: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``book`` far from each other: the first, then always the farthest."""
    picked = [0]
    gap = squared(book, book[:1])[:, 0]
    while len(picked) < min(n, len(book)):
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(book, book[picked[-1:]])[:, 0])
    return book[picked]


def nearest(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties: lower index) and squared distance of each part, and how many
    distances were evaluated. ``to_pivots``: the parts' squared distances to the pivots."""
    own, entry = np.sqrt(to_pivots), np.sqrt(squared(pivots, book))
    bound = np.zeros((len(x), len(book)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(own[:, p, None] - entry[p])
                   - SAFETY * (own[:, p, None] + entry[p]), out=bound)
    bound *= bound
    bound *= 1 - SAFETY
    rows = np.arange(len(x))
    code = bound.argmin(1)
    gap = x - book[code]
    best = np.einsum("nd,nd->n", gap, gap)
    evaluated = len(x)
    # what the first evaluation does not exclude, by row and ascending bound
    open_ = bound <= best[:, None]
    open_[rows, code] = False
    r, e = np.nonzero(open_)
    low = bound[r, e]
    order = np.lexsort((low, r))
    r, e, low = r[order], e[order], low[order]
    turn = np.arange(len(r)) - np.searchsorted(r, r)        # place of an entry in its row's order
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn, minlength=1)) if len(r) else []
    start = 0
    for end in ends:
        at = by_turn[start:end]
        at = at[low[at] <= best[r[at]]]
        start = end
        rr, ee = r[at], e[at]
        gap = x[rr] - book[ee]
        d = np.einsum("nd,nd->n", gap, gap)
        evaluated += len(at)
        closer = (d < best[rr]) | ((d == best[rr]) & (ee < code[rr]))
        best[rr[closer]], code[rr[closer]] = d[closer], ee[closer]
    return code, best, evaluated


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray):
    """Parts ``(n, parts, m)``, codes and squared distances ``(n, parts)`` of a batch."""
    n, parts, m = batch.num_rows, books.shape[0], books.shape[2]
    z = _matrix(batch.column("z"), n).reshape(n, parts, m)
    gaps = _matrix(batch.column("gaps"), n).reshape(n, parts, -1)
    code, best = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for k in range(parts):
        for at in range(0, n, STEP_ROWS):
            some = slice(at, at + STEP_ROWS)
            code[some, k], best[some, k], _ = nearest(z[some, k], gaps[some, k], books[k], pivots[k])
    return z, code, best


def _measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``gaps``: each part's squared distances to its position's pivots."""
    parts, _, m = pivots.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            z = _matrix(batch.column("z"), n).reshape(n, parts, m)
            gaps = np.stack([squared(z[:, k], pivots[k]) for k in range(parts)], 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(gaps.reshape(n, -1))], [*batch.schema.names, "gaps"])

    schema = T.StructType([*rows.schema.fields, T.StructField("gaps", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(measure, schema)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()),
                                    pa.array(np.ascontiguousarray(matrix, np.int64).ravel()))


def _sums(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``part, entry, n, total`` (componentwise sums), one row per task and used entry."""
    parts, entries, m = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, m), np.int64)
        for batch in batches:
            z, code, _ = _assigned(batch, books, pivots)
            for k in range(parts):
                at = code[:, k] + k * entries
                n += np.bincount(at, minlength=len(n))
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    total[used] += np.add.reduceat(z[order, k], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some // entries), pa.array(some % entries), pa.array(n[some]), _lists(total[some])],
            ["part", "entry", "n", "total"])

    return rows.mapInArrow(add_up, "part long, entry long, n long, total array<long>")


def _moved(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codebooks after one round: the floored means of what each entry was nearest to."""
    sums = _sums(rows, books, pivots).select(
        "part", "entry", F.col("n"), F.posexplode("total").alias("place", "s"))
    means = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    after = books.copy()
    for r in means.collect():           # at most a row per codebook component
        after[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    return after


def product_codes(vectors: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64,
                  rounds: int = 2, pivots: int = PIVOTS, vec_id: str = "vec_id",
                  embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes (array of entry numbers), error`` per usable vector, and the
    codebooks ``(parts, entries, components)``."""
    spark = vectors.sparkSession
    z = F.transform(F.col(embedding), lambda e: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(F.greatest(F.lit(-2.0 * LIMIT), F.least(
            F.lit(2.0 * LIMIT), e.cast("double") * scale))))).cast("long"))
    kept = stored(vectors.where(usable(embedding)).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), z.alias("z")), "vectors")
    longest = kept.agg(F.max(F.size("z"))).first()[0]
    result = T.StructType([kept.schema["vec_id"], kept.schema["label"],
                           T.StructField("codes", T.ArrayType(T.LongType())),
                           T.StructField("error", T.LongType())])
    if longest is None:
        return spark.createDataFrame([], result), np.zeros((parts, 0, 0), np.int64)
    width = parts * max(1, -(-longest // parts))
    padded = F.concat("z", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("z")))
    full = kept.withColumn("z", padded)
    first = full.orderBy(F.col("vec_id").asc_nulls_last(), "z").limit(entries).collect()
    books = np.array([r["z"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    points = np.stack([choose_pivots(book, pivots) for book in books])
    rows = stored(_measured(full, points), "measured")
    for _ in range(rounds):
        books = _moved(rows, books, points)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, best = _assigned(batch, books, points)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _lists(code), pa.array(best.sum(1))],
                ["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(encode, result), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label's vectors added up."""
    coded = stored(coded, "coded")
    sums = stored(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")),
                  "label_error")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal text."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_text(codes: str):
    """Two hexadecimal digits per code."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
