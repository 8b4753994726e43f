"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are counts of lower-case words and of their prefixes of 4 to 7 letters, once
divided by the square root of the text's length in words (so that the evidence of a count
and the counter-evidence of length keep their proportion) and once as a logarithm, with
the root and its inverse as two more. Grades are 0 for texts labelled clean and 1 to 3 for the thirds of the texts
labelled toxic by their share of telling features. One weight vector serves all ordered
thresholds: ``P(grade >= k) = sigmoid(w x - t_k)``. The expected severity is the sum of
these probabilities; a text is toxic if ``P(grade >= 1) >= cut``.

Training reads a bounded sample of the labelled rows: at most ``per_class`` per class,
those with the smallest hash of their id, weighted back to the class sizes. The texts are
reduced to features where they lie; one task fits the model, whose size is bounded by
``FEATURES``. Scoring covers every row and whole texts.

Defined results: null and empty texts, and texts without letters, have severity 0 and are
not toxic; labels that are null are ignored, of contradicting labels of an id the highest
counts, of texts that share an id the least is learned from; without labels of both classes nothing is toxic; repeated rows are scored each;
an empty table gives no rows; extra columns are ignored by ``severity`` and carried by
``reject_toxic``.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

PER_CLASS = 4000          # labelled rows per class that the model is fitted on, at most
FEATURES = 1024           # features kept
GRADES = 3
PREFIXES = (4, 5, 6, 7)
HASHES = 1 << 23          # feature hashes; counts over all of them fit a task
STEPS = 400
RIDGE = 1e-4
POWER = 0.5              # counts are divided by this power of the text's words
SCALE = 10.0              # feature units that bring weights near one
CUT = 0.5
CACHE_WORDS = 200_000
STEP_TEXTS = 16           # texts of a batch that are Python strings at once
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its prefixes."""
    names = [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(n.encode("utf-8", "replace")) % HASHES for n in names]


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-case words of a text, in parts."""
    return (WORD.findall(part) for part in slices((text or "").lower()))


def _probabilities(score: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 0 .. GRADES + 1."""
    p = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))
    return np.concatenate([np.ones((len(score), 1)), p, np.zeros((len(score), 1))], 1)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model (full-batch Adam)."""
    w, raw = np.zeros(x.shape[1]), np.array([2.0] + [0.0] * (GRADES - 1))
    m, v = [np.zeros_like(w), np.zeros_like(raw)], [np.zeros_like(w), np.zeros_like(raw)]
    rows, weight = np.arange(len(x)), weight / weight.sum()
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.append(raw[0], np.exp(raw[1:])))
        p = _probabilities(x @ w, t)
        hi, lo = p[rows, grade], p[rows, grade + 1]
        share = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        g_w = -(weight * (d_hi - d_lo) / share) @ x + RIDGE * w
        g_t = np.zeros(GRADES)
        np.add.at(g_t, np.maximum(grade - 1, 0), np.where(grade > 0, weight * d_hi / share, 0))
        np.add.at(g_t, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -weight * d_lo / share, 0))
        tail = np.cumsum(g_t[::-1])[::-1]
        g_raw = np.append(tail[0], tail[1:] * np.exp(raw[1:]))
        for i, (value, g) in enumerate(((w, g_w), (raw, g_raw))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            value -= 0.1 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return w, np.cumsum(np.append(raw[0], np.exp(raw[1:])))


def train(toxic: np.ndarray, n_words: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray],
          totals: tuple[int, int]) -> dict | None:
    """Fit the model on featurised documents; None without both classes."""
    if not toxic.any() or toxic.all():
        return None
    c1, c0, docs1 = (np.zeros(HASHES, np.uint32) for _ in range(3))
    for is_toxic, i, c in zip(toxic, ids, counts):      # an id occurs once per document
        (c1 if is_toxic else c0)[i] += c
        docs1[i] += is_toxic
    n1, n0 = n_words[toxic].sum(), n_words[~toxic].sum()
    known = np.flatnonzero(docs1 >= 2)
    ratio = np.log((c1[known] + 0.5) / (n1 + 1)) - np.log((c0[known] + 0.5) / (n0 + 1))
    gain = np.where(ratio > 1, c1[known] * ratio, 0.0)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    keep = known[best[gain[best] > 0]]
    del c1, c0, docs1                   # as large as all features; the matrix comes next
    m = len(keep)
    by_hash = np.argsort(keep)
    hashes = keep[by_hash]
    x = np.zeros((len(ids), 2 * m + 2))
    root = n_words ** POWER
    for row, i, c in zip(range(len(ids)), ids, counts):
        some = np.isin(i, hashes)
        at, c = by_hash[np.searchsorted(hashes, i[some])], c[some].astype(float)
        x[row, at] = SCALE * c / root[row]
        x[row, m + at] = np.log1p(c)
    share = x[:, :m].sum(1) * root / n_words
    x[:, -2], x[:, -1] = root / SCALE, SCALE / root
    cuts = np.quantile(share[toxic], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, share, "left"), 0)
    weight = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum())
    w, t = fit_ordinal(x, grade, weight)
    weights = zip((SCALE * w[:m]).tolist(), w[m:2 * m].tolist())
    return {"features": dict(zip(keep.tolist(), weights)),
            "root": float(w[-2]) / SCALE, "inverse": float(w[-1]) * SCALE, "thresholds": t.tolist()}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic", per_class: int = PER_CLASS) -> dict | None:
    """Model from a bounded sample of labelled rows."""
    known = stored(labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
                   .groupBy(F.col(doc_id).alias("__souk_id")).agg((F.max(label) > 0).alias("__souk_toxic")),
                   "labels")
    sizes = {r["__souk_toxic"]: r["count"] for r in known.groupBy("__souk_toxic").count().collect()}
    order = [F.xxhash64("__souk_id"), F.col("__souk_id")]
    picked = stored(known.where("__souk_toxic").orderBy(*order).limit(per_class).unionByName(
        known.where("not __souk_toxic").orderBy(*order).limit(per_class)), "picked")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, body, toxic in zip(batch["place"], batch["text"], batch["toxic"]):
                words: Counter = Counter()
                for part in words_of(body):
                    words.update(part)
                found: Counter = Counter()
                for word, n in words.items():
                    for f in features_of(word):
                        found[f] += n
                if words:
                    out.append((place, toxic, words.total(), np.fromiter(found, np.uint32, len(found)).tobytes(),
                                np.fromiter(found.values(), np.uint32, len(found)).tobytes()))
            yield pd.DataFrame(out, columns=["place", "toxic", "n", "ids", "counts"])

    # the sample has at most 2 * per_class rows
    sample = (docs.select(F.col(doc_id).alias("__souk_doc"), F.col(text).alias("text"))
              .join(F.broadcast(picked), F.col("__souk_doc") == F.col("__souk_id"))
              .groupBy("__souk_id", F.col("__souk_toxic").alias("toxic")).agg(F.min("text").alias("text"))
              .select(F.xxhash64("__souk_id").alias("place"), "text", "toxic")
              .mapInPandas(featurise, "place long, toxic boolean, n long, ids binary, counts binary"))

    def learn(found: pa.Table) -> pa.Table:
        order = np.argsort(found["place"].to_numpy(), kind="stable")    # one order of the sums, whatever came first
        ids, counts = ([np.frombuffer(b.as_buffer(), np.uint32) for b in found[c]] for c in ("ids", "counts"))
        model = train(found["toxic"].to_numpy().astype(bool)[order], found["n"].to_numpy().astype(float)[order],
                      [ids[i] for i in order], [counts[i] for i in order],
                      (sizes.get(False, 0), sizes.get(True, 0)))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    row = sample.groupBy(F.lit(1).alias("one")).applyInArrow(learn, "model binary").first()
    return pickle.loads(row["model"]) if row else None


class Scorer:
    """Expected severity and probability of being toxic of whole texts."""

    def __init__(self, model: dict):
        self.model, self.thresholds = model, np.array(model["thresholds"])
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> list[int] | None:
        """The model's features of a word, or None."""
        found = [f for f in features_of(word) if f in self.model["features"]] or None
        if len(self.cache) < CACHE_WORDS:
            self.cache[word] = found
        return found

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        cache, word, weights = self.cache, self.word, self.model["features"]
        for i, text in enumerate(texts):
            counts: Counter = Counter()
            for words in words_of(text):
                n[i] += len(words)
                found = [cache[w] if w in cache else word(w) for w in words]
                counts.update(f for some in filter(None, found) for f in some)
            root = max(1, n[i]) ** POWER
            total[i] = (sum(k / root * weights[f][0] + math.log1p(k) * weights[f][1]
                            for f, k in sorted(counts.items()))
                        + self.model["root"] * root + self.model["inverse"] / root)
        p = _probabilities(total, self.thresholds)[:, 1:-1]
        p[n == 0] = 0.0
        return p.sum(1), p[:, 0]


def _scored(docs: DataFrame, model: dict | None, text: str) -> DataFrame:
    """``docs`` with ``__souk_severity`` and ``__souk_toxic`` (probability)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    if model is None:
        return docs.select(*names, F.lit(0.0).alias("__souk_severity"), F.lit(0.0).alias("__souk_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)    # at most FEATURES weights

    @F.arrow_udf("severity double, toxic double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            parts = [scorer.score(texts.slice(at, STEP_TEXTS).to_pylist())
                     for at in range(0, max(1, len(texts)), STEP_TEXTS)]
            severity, toxic = (np.concatenate(p) for p in zip(*parts))
            yield pa.StructArray.from_arrays([pa.array(severity), pa.array(toxic)], ["severity", "toxic"])

    both = docs.select(*names, score(F.col(text)).alias("__souk_score"))
    return both.select(*names, F.col("__souk_score.severity").alias("__souk_severity"),
                       F.col("__souk_score.toxic").alias("__souk_toxic"))


def severity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
             cut: float = CUT, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic``: every document's expected severity and verdict."""
    model = fit(docs, labels, text, doc_id, per_class=per_class)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _scored(named, model, "text").select(
        "doc_id", F.col("__souk_severity").alias("severity"), F.col("__souk_toxic").alias("p_toxic"),
        (F.col("__souk_toxic") >= cut).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 cut: float = CUT, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not toxic, columns as they came."""
    model = fit(docs, labels, text, doc_id, per_class=per_class)
    return (_scored(docs, model, text).where(F.col("__souk_toxic") < cut)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
