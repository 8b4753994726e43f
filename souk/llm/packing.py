"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is a configuration linear program over the histogram of piece lengths (at most
``capacity`` bins, whatever the corpus size): minimise the number of sequences such that
the chosen configurations (multisets of lengths that fit one sequence) cover every
length as often as it occurs. It is solved by multiplicative weights. Each round

* prices every length by its weight, which shrinks exponentially with its coverage,
* solves the pricing knapsack by dynamic programming, which also yields the best
  configuration through each single length, and
* raises all configurations whose value is near the best, each length by one small step
  of its count at most.

The prices divided by the best value are dual feasible and give a lower bound. The
fractional counts are rounded systematically, limited by the histogram, and what is left
over is packed best-fit decreasing into the holes and new sequences, length class by
length class (never item by item).

Pieces are numbered within their length by per-task counters and a window over one row
per (task, length), and each number maps to a sequence and offset by binary search in
the plan. No piece list reaches the driver; texts are never shuffled.

Defined results: a null text counts as empty and yields the end token alone; repeated
rows are packed separately; an empty table gives no rows; null ids and extra columns are
carried or ignored, as ``doc_id`` only labels the output.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

STEP = 0.05               # share of a length's count covered in one round at most
NEAR = 0.02               # configurations within this share of the best are raised
SHARPNESS = 6.0           # exponent of the weights per unit of coverage
ROUNDS = 400
CACHE_WORDS = 300_000     # words per cache generation of a Python worker (two are kept)
GROUP_CHARS = 3_000_000   # characters of texts looked up together

END_ID = 0
BEYOND_LATIN = re.compile("[^\\x00-\u017f]")


# ---- tokens -----------------------------------------------------------------------

def worker_state() -> dict:
    """A dictionary that lives as long as this Python worker, across its tasks."""
    import tokenizers

    return tokenizers.__dict__.setdefault("_souk_worker_state", {})


def _letters(word: str) -> bool:
    """Whether a word is still all letters once composed and in lower case: some letters turn
    into a letter and a mark, which the tokenizer joins with what follows."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


class WordTokenizer:
    """Token ids of whole texts by a tokenizer that never joins tokens over white space.

    Ids of a text are the ids of its words in order, so words are looked up in a bounded
    cache; unknown words are encoded together, parted by a one-token marker word.
    """

    MARK = "|"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        # the usual byte-level alphabet: printable bytes stand for themselves, the others for
        # the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.byte_alphabet = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.inner.encode(self.MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the marker word must be a single token")
        self.mark = mark[0]
        self.tails = dict(zip(".,", self._encode_words([".", ","])))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. A word of letters in lower case is one piece of the model: the
        byte alphabet of ASCII letters is the letters themselves, others are looked up."""
        tokenise, out, others = self.model.tokenize, [], []
        for w in words:
            if not w.isalpha():
                others.append(w)
                out.append(None)
                continue
            if not w.isascii():
                if not (w.islower() and max(w) < "\u0180" and is_normalized("NFC", w)):
                    others.append(w)
                    out.append(None)
                    continue
                w = "".join(map(self.byte_alphabet.__getitem__, w.encode()))
            elif not w.islower():
                w = w.lower()
            out.append(array("I", [t.id for t in tokenise(w)]).tobytes())
        if others:
            rest = iter(self._encode_others(others))
            out = [next(rest) if ids is None else ids for ids in out]
        return out

    def _encode_others(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if self.MARK not in w]
        found = {}
        if plain:
            text = f" {self.MARK} ".join(plain)
            ids = np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                           "<u4")
            cuts = 4 * np.flatnonzero(ids == self.mark)
            if len(cuts) == len(plain) - 1:
                raw = ids.tobytes()
                found = {w: raw[lo:hi] for w, lo, hi in
                         zip(plain, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])}
        rest = [w for w in words if w not in found]
        if rest:
            for w, e in zip(rest, self.inner.encode_batch_fast(rest, add_special_tokens=False)):
                found[w] = np.array(e.ids, "<u4").tobytes()
        return [found[w] for w in words]

    @staticmethod
    def prepare(text: str) -> str:
        """A text with the same ids and fewer different words: case is dropped in texts of
        Latin letters, as the tokenizer does in any case."""
        return text if "<|" in text or BEYOND_LATIN.search(text) else text.lower()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        group, chars = [], 0
        for text in texts:
            if len(text) > GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
                yield np.concatenate([ids for part in slices(text, GROUP_CHARS)
                                      for ids in self._encode_group([part])])
                continue
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[str]) -> Iterator[np.ndarray]:
        """Words as numbers of a dictionary (Arrow), ids of its words, ids of all by gathering."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not group:
            return
        split = pc.ascii_split_whitespace(pa.array(map(self.prepare, group), pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        by_word = pa.LargeListArray.from_arrays(np.append(0, ends), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        found = by_word.take(coded.indices)
        tokens = found.flatten().to_numpy()
        bounds = found.offsets.to_numpy()[split.offsets.to_numpy()]
        del split, coded, ids, by_word
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield tokens[lo:hi]
        del found, tokens
        pa.default_memory_pool().release_unused()

    def _ids_of(self, wanted: list[str]) -> list[bytes]:
        if len(self.words) + len(wanted) > CACHE_WORDS:
            # two generations: words in use move on, the others are forgotten
            self.old, self.words = self.words, {}
        words, old, tails = self.words, self.old, self.tails
        unknown, tailed = set(), []
        for w in wanted:
            if w in words:
                continue
            if w in old:
                words[w] = old[w]
            elif w[-1:] in tails and _letters(w[:-1]):
                # letters and a final stop or comma are pieces of their own in any case
                tailed.append(w)
                core = w[:-1]
                if core in old:
                    words[core] = old[core]
                elif core not in words:
                    unknown.add(core)
            else:
                unknown.add(w)
        fresh = list(unknown)
        words.update(zip(fresh, self._encode_words(fresh)))
        for w in tailed:
            words[w] = words[w[:-1]] + tails[w[-1]]
        return [words[w] for w in wanted]


def tokenizer(path: str) -> WordTokenizer:
    state = worker_state()
    if ("tokenizer", path) not in state:
        state["tokenizer", path] = WordTokenizer(path)
    return state["tokenizer", path]


# ---- plan -------------------------------------------------------------------------

def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price and last item (-1: none) for every capacity; lengths ascend."""
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fits[c]
        value = best[c - lengths[:k]] + price[:k]
        j = int(value.argmax())
        if value[j] >= best[c - 1]:
            best[c], item[c] = value[j], j
        else:
            best[c] = best[c - 1]
    return best, item


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list, float]:
    """Fractional configurations ``[(items, amount)]`` and a lower bound of the optimum."""
    n, m = counts.astype(float), len(lengths)
    covered, bound = np.zeros(m), float((lengths * n).sum() / capacity)
    amounts: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        if covered.min() >= 1:
            break
        price = lengths / capacity * np.exp(-SHARPNESS * (covered - covered.min()))
        best, item = knapsack(lengths, price, capacity)
        bound = max(bound, float((n * price).sum() / best[capacity]))
        through = price + best[capacity - lengths]
        near = np.flatnonzero((through >= (1 - NEAR) * best[capacity]) & (covered < 1))
        near = near[np.argsort(covered[near], kind="stable")]
        # the best configuration through each near length: walk the table for all at once
        picks, at = [near], capacity - lengths[near]
        while True:
            skip = (item[at] < 0) & (at > 0)
            while skip.any():
                at = np.where(skip, at - 1, at)
                skip = (item[at] < 0) & (at > 0)
            j = item[at]
            if (j < 0).all():
                break
            picks.append(j)
            at = np.where(j >= 0, at - lengths[np.maximum(j, 0)], at)
        quota = np.minimum(STEP, np.maximum(0.0, 1 - covered)) * n
        quota[covered >= 1] = STEP * n[covered >= 1]
        start = quota.copy()
        for column in np.stack(picks, 1):
            items, times = np.unique(column[column >= 0], return_counts=True)
            amount = float((quota[items] / times).min())
            if amount > 1e-9:
                quota[items] -= amount * times
                key = tuple(zip(items.tolist(), times.tolist()))
                amounts[key] = amounts.get(key, 0.0) + amount
        covered += (start - quota) / n
    return sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0])), bound


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple, int]], float]:
    """``[(((length, times), ...), sequences)]`` that hold every piece exactly once."""
    left = dict(histogram)
    chosen: list[tuple[tuple, int]] = []
    if left.get(capacity):
        chosen.append((((capacity, 1),), left.pop(capacity)))
    full = chosen[0][1] if chosen else 0
    if not left:
        return chosen, float(full)
    lengths = np.array(sorted(left), np.int64)
    fractional, bound = solve(lengths, np.array([left[l] for l in lengths.tolist()]), capacity)
    total = 0.0
    bins: dict[int, list] = {}          # free space -> [[items, sequences]]
    for items, amount in fractional:
        whole = int(np.floor(total + amount + 0.5) - np.floor(total + 0.5))
        total += amount
        content = tuple((int(lengths[i]), t) for i, t in items)
        whole = min([whole, *(left[l] // t for l, t in content)])
        if whole:
            for l, t in content:
                left[l] -= whole * t
            free = capacity - sum(l * t for l, t in content)
            bins.setdefault(free, []).append([content, whole])
    for l in sorted(left, reverse=True):
        need = left[l]
        while need:
            free = min((f for f in bins if f >= l and bins[f]), default=None)
            content, have = bins[free].pop() if free is not None else ((), need)
            room = capacity if free is None else free
            times = min(room // l, need)
            used = min(have, need // times)
            need -= used * times
            if free is not None and have > used:
                bins[free].append([content, have - used])
            bins.setdefault(room - times * l, []).append([(*content, (l, times)), used])
    chosen += [(content, times) for free in sorted(bins) for content, times in bins[free] if times]
    return chosen, bound + full


class Places:
    """Where the r-th piece of a length goes: arrays bounded by the plan, not the data."""

    SPAN = 1 << 44

    def __init__(self, chosen: list[tuple[tuple, int]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for content, times in chosen:
            offset = 0
            for length, per in content:
                first = taken.get(length, 0)
                rows.append((length * self.SPAN + first, first, per, sequence, offset))
                taken[length] = first + per * times
                offset += length * per
            sequence += times
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.first, self.per, self.sequence, self.offset = table.T.copy()

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length * self.SPAN + rank, "right") - 1
        d = rank - self.first[i]
        return self.sequence[i] + d // self.per[i], self.offset[i] + d % self.per[i] * length


# ---- operator ---------------------------------------------------------------------

def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048,
                   text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids``, little-endian unsigned 32-bit, with ``keep_ids``)."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    # ids travel as text: pandas would turn whole numbers beside a null into floats
    schema = ("doc_id string, piece int, start long, length long, ids_crc32 long, "
              "task long, number long" + (", ids binary" if keep_ids else ""))

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, task = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for key, ids in zip(batch["doc_id"], words.encode([t or "" for t in batch["text"]])):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo:lo + capacity].tobytes()
                    n = len(part) // 4
                    out.append((key, piece, lo, n, zlib.crc32(part), task, seen[n], part))
                    seen[n] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32",
                                               "task", "number", "ids"])
            yield frame if keep_ids else frame.drop(columns="ids")

    pieces = stored(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
                    .mapInPandas(tokenise, schema), "pieces")
    dealt = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "dealt")
    histogram = {r["length"]: r["n"] for r in
                 dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    chosen, _ = plan(histogram, capacity) if histogram else ([], 0.0)
    places = spark.sparkContext.broadcast(Places(chosen).__dict__)   # bounded by the plan
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")
                             .rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(dealt.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")),
                    "starts")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = pieces.join(starts, ["length", "task"]) \
        .select(*names, (F.col("before") + F.col("number")).alias("number"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = Places.__new__(Places)
        where.__dict__.update(places.value)
        for batch in batches:
            sequence, offset = where.of(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield batch[names].assign(sequence_id=sequence, offset=offset)

    placed = numbered.mapInPandas(
        place, "doc_id string, piece int, start long, length long, ids_crc32 long, "
        + ("ids binary, " if keep_ids else "") + "sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(id_type))
