"""The pipeline, stage by stage, against plain Python; the toxicity model against plain formulas."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from souk.llm import simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string"
KEY = "deadbeef00112233445566"


def _corpus():
    rng = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "re") for b in ("na", "ri", "sol") for c in ("", "ta", "vo", "ne")]
    rows, labels = [], []
    for i in range(160):
        text = list(rng.choice(words, rng.integers(30, 90)))
        if i % 8 == 0:
            for at in rng.integers(0, len(text), len(text) // 5):
                text[at] = str(rng.choice(["grumpf", "zorkish", "zorking", "zorky"]))
        if i % 10 == 3:
            text[5] = f"password={KEY}"
        if i % 10 == 4:
            text[7:7] = [f"AKIA{'A' * 16}", KEY * 2]
        rows.append([i, " ".join(text) + ".", "en", ["hot", "hot", "b", None][i % 4]])
        if i < 120:
            labels.append((i, int(i % 8 == 0)))
    rows += [[1000 + i, rows[i][1], "en", "b"] for i in range(40, 60)]                  # copies
    rows += [[1100 + i, rows[i][1].upper() + " x", "en", "hot"] for i in (41, 42)]      # near copies
    rows += [[2000, None, "en", "b"], [2001, "", "en", "hot"], [2002, " \n", None, None],
             [None, "kona lisol muna " * 9, "en", "b"], [7, rows[7][1], "en", rows[7][3]], [7, rows[7][1], "de", "b"]]
    return [(*r, len(r[1]) if r[1] else 0, "h", "s") for r in rows], labels


def _plain_toxic(model, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return 0.0, 0.0
    counts = collections.Counter()
    for w in words:
        for name in [w] + [w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k]:
            counts[zlib.crc32(name.encode()) % (1 << 23)] += 1
    root = math.sqrt(len(words))
    score = model["root"] * root + model["inverse"] / root
    for f, (linear, log) in model["features"].items():
        if counts[f]:
            score += counts[f] / root * linear + math.log(1 + counts[f]) * log
    p = [1 / (1 + math.exp(t - score)) for t in model["thresholds"]]
    return p[0], sum(p)


def _plain_dedup(rows):
    prints = [simhash.simhash64(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            label[i] = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3)
    first = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if label[i] not in first or key < first[label[i]][0]:
            first[label[i]] = (key, i)
    return first, label


BASE = [(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{12,})", 0),
        (r"AKIA[A-Z0-9]{14,}", 0), (r"[0-9a-f]{16,}", 0)]


def _plain_mask(text):
    if text is None:
        return None
    hidden = sorted((m.start(), m.end()) for p, _ in BASE for m in re.finditer(p, text))
    merged = []
    for lo, hi in hidden:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    for lo, hi in reversed(merged):
        text = text[:lo] + "[SECRET]" + text[hi:]
    return text


def _plain_mix(rows):
    """Copies of each row: shared targets, certain copies, then Pareto order up to the target."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped, level = set(), 0
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and 3 * total[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    copies = [0] * len(rows)
    for s in sources:
        target = min(weight[s] * level, 3.0 * total[s])
        e = target / total[s] if total[s] else 0.0
        whole, p = math.floor(e), e - math.floor(e)
        seen, drawn = collections.Counter(), []
        for i, r in enumerate(rows):
            if r[3] != s:
                continue
            copies[i] = whole
            h = hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "null"
            seen[r[0], h] += 1
            digest = hashlib.md5("\x1f".join(["42", "" if r[0] is None else str(r[0]), h, str(seen[r[0], h])]).encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 2 ** 52
            if p > 0 and size[i]:
                odds = (u / (1 - u)) / (p / (1 - p))
                drawn.append((math.floor(odds / (1 + odds) * 2 ** 52), i))
        wanted, taken, best = target - total[s] * whole, 0, (target - total[s] * whole, 0)
        for k, (_, i) in enumerate(sorted(drawn), 1):
            taken += size[i]
            best = min(best, (abs(taken - wanted), k))
        for _, i in sorted(drawn)[:best[1]]:
            copies[i] += 1
    return copies


def _count(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept, plain = {}, corpus_pipeline.stored
    corpus_pipeline.stored = lambda df, name: kept.setdefault(name, plain(df, name))
    try:
        corpus_pipeline.run(spark, str(folder))
    finally:
        corpus_pipeline.stored = plain
    return folder, rows, {name: (df.columns, df.collect()) for name, df in kept.items()}


def test_stages_in_order_with_the_columns_of_documents(stages):
    _, _, kept = stages
    assert list(kept) == [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_dedup", "secret_scan", "mixing", "packing"]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert all(kept[n][0] == names for n in list(kept)[:-1])


def test_toxic_documents_go(spark, stages):
    folder, rows, kept = stages
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    want = [r for r in rows if _plain_toxic(model, r[1])[0] < 0.5]
    assert _count(kept["toxicity"][1]) == _count(want)
    gone = {r[0] for r in rows} - {r[0] for r in want}
    assert len(gone) >= 15 and all(i % 8 == 0 for i in gone)


def test_one_document_of_each_group_stays(stages):
    _, _, kept = stages
    before, after = kept["toxicity"][1], kept["simhash_dedup"][1]
    first, label = _plain_dedup(before)
    assert sorted(str(r[0]) for r in after) == sorted(str(before[i][0]) for _, i in first.values())
    assert _count(after) <= _count(before) and len(after) < len(before) - 15


def test_secrets_are_masked_and_nothing_else(stages):
    _, _, kept = stages
    want = [(*r[:1], _plain_mask(r[1]), *r[2:4], len(_plain_mask(r[1])) if r[1] is not None else None, *r[5:])
            for r in kept["simhash_dedup"][1]]
    assert _count(kept["secret_scan"][1]) == _count(want)
    assert sum("[SECRET]" in (r[1] or "") for r in want) >= 20


def test_mix_takes_each_document_as_often_as_drawn(stages):
    _, _, kept = stages
    rows = kept["secret_scan"][1]
    want = [r for r, n in zip(rows, _plain_mix(rows)) for _ in range(n)]
    assert _count(kept["mixing"][1]) == _count(want) and len(want) > len(rows) // 2


def test_pieces_hold_all_tokens_of_the_mix(stages):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(TOKENIZER)
    _, _, kept = stages
    names, got = kept["packing"]
    want = collections.Counter()
    for r in kept["mixing"][1]:
        ids = inner.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[lo:lo + 2048], "<u4").tobytes()
            want[r[0], k, lo, len(part) // 4, zlib.crc32(part)] += 1
    assert _count(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1


# ---- the toxicity model -------------------------------------------------------------

def test_scores_equal_the_plain_formula(spark, stages):
    folder, rows, _ = stages
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = collections.defaultdict(list)
    for r in toxicity.severity(docs, labels).collect():
        got[r.doc_id].append((r.p_toxic, r.severity, r.toxic))
    for r in rows:
        p, severity = _plain_toxic(model, r[1])
        assert any(a == pytest.approx(p, abs=1e-9) and b == pytest.approx(severity, abs=1e-9) and c == (p >= 0.5)
                   for a, b, c in got[r[0]])


def test_fit_is_the_optimum_of_the_plain_likelihood():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    grade = np.clip(np.round(1.2 + x @ [0.8, -0.5, 0.0] + 0.6 * rng.normal(size=300)), 0, 3).astype(int)
    weight = rng.uniform(0.5, 2, 300)
    w, t = toxicity.fit_ordinal(x, grade, weight)

    def loss(w, t):
        """Weighted mean of -log P(grade), written out per row, with the ridge."""
        total = 0.0
        for row, g, k in zip(x, grade, weight):
            at_least = [1.0] + [1 / (1 + math.exp(c - float(row @ w))) for c in t] + [0.0]
            total -= k * math.log(at_least[g] - at_least[g + 1])
        return total / weight.sum() + toxicity.RIDGE / 2 * float(w @ w)

    best = loss(w, t)
    for _ in range(12):
        dw, dt = rng.normal(size=3), rng.normal(size=3)
        for step in (0.05, 0.3):
            assert loss(w + step * dw, np.sort(t + step * dt)) > best
    slope = [(loss(w + d, t) - loss(w - d, t)) / 2e-4 for d in np.eye(3) * 1e-4]
    assert np.abs(slope).max() < 1e-3
