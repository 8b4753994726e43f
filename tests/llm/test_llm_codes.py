"""Vector codes, importance resampling and license scans against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from souk.llm import license_scan as lic
from souk.llm import resampling, vector_codes

INF, NAN = float("inf"), float("nan")


# ---- vector codes -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label string, z string, gaps string, code string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "z", "gaps", "code") for i, v, lab in rows], VECTORS)


def _plain_codes(z, parts, entries, rounds):
    """All distances, in Python's integers."""
    m = len(z[0]) // parts
    cut = [[tuple(v[p * m:(p + 1) * m]) for p in range(parts)] for v in z]
    books = [[cut[i][p] for i in range(min(entries, len(z)))] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, g in groups.items():
                books[p][k] = tuple(sum(c) // len(g) for c in zip(*g))
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [[k for _, k in f] for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("seed", range(6))
def test_pivot_bounds_never_lose_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    size = [3, 50, 1 << 26][seed % 3]
    x, book = rng.integers(-size, size + 1, (400, 5)), rng.integers(-size, size + 1, (40, 5))
    book[7] = book[3]                           # a tie
    x[:40] = book
    pivots = vector_codes.choose_pivots(book, 4)
    code, best, evaluated = vector_codes.nearest(x, vector_codes.squared(x, pivots), book, pivots)
    d = vector_codes.squared(x, book)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert evaluated < d.size                   # the bounds prune


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[40:70] = v[5]                             # a third of all rows alike
    ids = list(range(90))
    random.Random(1).shuffle(ids)
    rows = [(ids[i], [float(x) for x in r], None if i % 3 == 0 else f"l{i % 2}") for i, r in enumerate(v)]
    awkward = [(900, None, "l1"), (901, [1.0, None], "l1"), (902, [NAN] * 8, None), (903, [INF] * 8, "x")]
    coded, books = vector_codes.product_codes(_vectors(spark, rows + awkward), parts=4, entries=8, rounds=2)
    got = {r["vec_id"]: r for r in vector_codes.with_label_error(coded).collect()}
    by_id = sorted(rows)
    z = [[math.floor(256 * x) for x in r[1]] for r in by_id]
    codes, errors, want = _plain_codes(z, 4, 8, 2)
    assert books.tolist() == [[list(e) for e in b] for b in want]
    assert sorted(got) == [r[0] for r in by_id]
    total = {}
    for (_, _, label), e in zip(by_id, errors):
        total[label] = total.get(label, 0) + e
    for (i, _, label), c, e in zip(by_id, codes, errors):
        assert (got[i]["codes"], got[i]["error"], got[i]["label_error"]) == (c, e, total[label])
    text = ",".join(str(x) for b in want for e in b for x in e)
    assert vector_codes.book_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_odd_lengths_repeats_and_nothing(spark):
    big = 2 ** 62 + 1
    rows = [(big, [1.0, 2.0, 3.0], "a"), (big, [1.0, 2.0, 3.0], "a"), (None, [1.0], None), (4, [], None),
            (5, [3e38, -3e38], "b")]
    coded, books = vector_codes.product_codes(_vectors(spark, rows), parts=4, entries=64, rounds=2)
    got = vector_codes.with_label_error(coded).collect()
    assert books.shape == (4, 5, 1)             # padded to four components, as few entries as vectors
    assert sorted((r["vec_id"] or 0, r["error"]) for r in got) == [(0, 0), (4, 0), (5, 0), (big, 0), (big, 0)]
    none, books = vector_codes.product_codes(_vectors(spark, []))
    assert vector_codes.with_label_error(none).collect() == [] and books.size == 0
    only_null = vector_codes.product_codes(_vectors(spark, [(1, None, "a")]))[0]
    assert only_null.collect() == []


# ---- importance resampling ----------------------------------------------------------

DOCS = "doc_id long, text string, weight string, score string, rank string, found string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "s", "r", "f") for i, t in rows], DOCS)


def _plain_resample(docs, target, percent, least, ngrams, buckets, seed=2024):
    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(ws), [" ".join(ws[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(ws) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in feats(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in feats(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    out = []
    for i, text in docs:
        n, fs = feats(text)
        w = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    place = {}
    for r, x in enumerate(order[:len(order) * percent // 100], 1):
        place.setdefault((x[0], x[2], x[3], x[4]), []).append(r)
    rows = []
    for i, _, n, w, sc in out:
        left = place.get((i, n, w, sc))
        rows.append((i, n, w, sc, left.pop(0) if left else None))
    return rows


def _key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("ngrams,percent", [(1, 10), (2, 40), (3, 100)])
def test_resampling_equals_brute_force(spark, ngrams, percent):
    rng = random.Random(ngrams)
    words = ["alpha", "Beta", "gamma", "ÄÖ", "x1", "delta", "eps", "zeta's", "日本語"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(120)]
    docs += [(7, "alpha beta " * 20)] * 30 + [(None, "gamma " * 25)] * 40 + [(500, None), (501, ""), (None, None)]
    target = ["alpha beta alpha", "", None, "x1 gamma"]
    frame = _docs(spark, docs).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, aims, percent, 6, ngrams, 97).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(
        _plain_resample(docs, target, percent, 6, ngrams, 97), key=_key)


def test_cutoff_inside_equal_rows_and_among_null_ids(spark):
    docs = [(None, "a " * 20)] * 10
    got = resampling.resample(_docs(spark, docs), _docs(spark, []), 50, 20).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 10
    docs = [(3, "a " * 20)] * 6 + [(2, "a " * 20)] * 4
    got = resampling.resample(_docs(spark, docs), _docs(spark, docs), 50, 20).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert resampling.resample(_docs(spark, []), _docs(spark, []), 10, 20).collect() == []


def test_bisection_finds_the_least_number(spark):
    rng = random.Random(3)
    for low, high in ((-5, 5), (-10 ** 6, 10 ** 6), (-2 ** 62, 2 ** 62)):
        xs = sorted(rng.randrange(low, high) for _ in range(50))
        frame = spark.createDataFrame([(x,) for x in xs], "x long")
        from pyspark.sql import functions as F
        for k in (1, 17, 50):
            assert resampling.least_reaching(frame, F.col("x"), k, xs[0], xs[-1]) == xs[k - 1]


# ---- license scans ------------------------------------------------------------------

def _reach(text, starts, part, k):
    """Ends of ``part`` with at most ``k`` edits behind any of ``starts``: all of them."""
    ends = set()
    for s in starts:
        row = list(range(len(part) + 1))        # edit distances of the part's prefixes to text[s:e]
        if row[-1] <= k:
            ends.add(s)
        for e in range(s + 1, min(len(text), s + len(part) + k) + 1):
            new = [row[0] + 1]
            for j, c in enumerate(part, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != text[e - 1])))
            row = new
            if row[-1] <= k:
                ends.add(e)
    return ends


def _plain_labels(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    norm = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    edges = {0, len(norm)} | {i for i, c in enumerate(norm) if c == " "}
    firsts = {0} | {i + 1 for i, c in enumerate(norm) if c == " "}
    found = set()
    for label, parts in lic.NOTICES:
        at = firsts
        for part, k in parts:
            at = _reach(norm, at, part, k)
        if at & edges - ({0} if norm else set()):
            found.add(label)
    return found


def _mutated(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[i] = rng.choice("abcdefg hi")
        elif what == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcdefg hi"))
    return "".join(s)


def test_notices_equal_brute_force_edit_distances():
    rng = random.Random(8)
    scanner = lic.Scanner(lic.PHRASES, lic.NOTICES)
    for round_ in range(90):
        label, parts = lic.NOTICES[round_ % len(lic.NOTICES)]
        whole = "".join(p for p, _ in parts)
        text = f"lorem under the {_mutated(rng, whole, rng.randrange(0, 2 + sum(k for _, k in parts)))} ipsum, dolor"
        got = {n[0] for n in scanner.scan(text.encode())[2]}
        assert got == _plain_labels(text), text


def test_spans_name_the_notice_in_the_text(spark):
    text = "Überschrift — Relesed\n# under the MIT licence. Licensed under CC BY-NC 4.0.\n" + "x " * 50
    rows = [(1, text), (1, text), (None, "MIT License, mit-license and MIT LICENSES"), (3, None), (4, ""), (5, "— !"),
            (6, "gnu general public\nLICENSE cc by"), (7, "the exit license of this house is released under the rug")]
    frame = spark.createDataFrame([(i, t, "n", "p") for i, t in rows],
                                  "doc_id long, text string, notices string, places string")
    found = lic.license_scan(frame)
    first = [r for r in found.collect() if r["doc_id"] == 1][0]
    spans = {n["label"]: text[n["start"]:n["end"]] for n in first["notices"]}
    assert spans == {"mit": "Relesed\n# under the MIT licence", "cc-by-nc": "Licensed under CC BY-NC 4.0"}
    assert [n["edits"] for n in first["notices"]] == [2, 0]
    got = sorted((tuple(r) for r in lic.labels_and_score(found).drop("spans").collect()), key=_key)
    one = (1, 64, 1, 9, 9, "cc-by", "cc-by,cc-by-nc,mit", 1.0)
    assert got[:2] == [one, one]
    assert got[2:] == [(3, 0, 0, None, None, "", "", 0.0), (4, 0, 0, None, None, "", "", 0.0),
                       (5, 1, 0, None, None, "", "", 0.0), (6, 6, 2, 0, 4, "cc-by,gpl", "cc-by,gpl", 1.0),
                       (7, 11, 0, None, None, "", "", 0.0), (None, 7, 2, 0, 2, "mit", "mit", 1.0)]
    assert lic.labels_and_score(lic.license_scan(frame.limit(0))).collect() == []


def test_base_places_equal_a_plain_scan():
    rng = random.Random(5)
    scanner = lic.Scanner(lic.PHRASES, lic.NOTICES)
    words = ["mit", "License", "cc", "by", "apache", "gnu", "general", "public", "license", "é", "x9"]
    for _ in range(300):
        text = rng.choice(["", "-"]) + "".join(rng.choice(words) + rng.choice([" ", "\n", "-", ", ", "\x7f"]) for _ in range(40))
        low = text.lower()
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = [(label, i) for i in range(len(ws)) for phrase, label in lic.PHRASES
                if ws[i:i + len(phrase.split())] == phrase.split()]
        n, places, _ = scanner.scan(text.encode())
        assert n == len(ws) and sorted(places) == sorted(want)


def test_a_very_long_text_with_many_notices_is_scanned_whole():
    scanner = lic.Scanner(lic.PHRASES, lic.NOTICES)
    text = ("word " * 1000 + "Released under the MIT License. ") * 200
    n, places, notices = scanner.scan(text.encode())
    assert n == 200 * 1005 and len(places) == len(notices) == 200
    assert all(text[s:e] == "Released under the MIT License" for _, _, _, s, e, _, _ in notices)


def test_overlapping_places_of_a_notice_cost_no_place_apart_from_the_best():
    # the middle one has fewest edits; of a chain whose ends have fewer both ends stay
    assert list(lic._apart({(2, 0, 10), (1, 8, 18), (2, 16, 26)})) == [(1, 8, 18)]
    assert sorted(lic._apart({(1, 0, 10), (2, 8, 18), (1, 16, 26)})) == [(1, 0, 10), (1, 16, 26)]
    assert list(lic._apart({(1, 4, 9), (1, 0, 5)})) == [(1, 0, 5)] and list(lic._apart(set())) == []
    rng = random.Random(3)
    for _ in range(500):
        spans = {(rng.randint(0, 3), lo, lo + rng.randint(1, 9)) for lo in rng.sample(range(40), rng.randint(0, 12))}
        stay = []
        for edits, lo, hi in sorted(spans):
            if all(hi <= a or lo >= b for _, a, b in stay):
                stay.append((edits, lo, hi))
        assert list(lic._apart(spans)) == stay


def test_words_are_whole_where_a_long_text_is_worked_on_in_parts():
    text = "MIT,  License\x00é" * 150_000 + " " * (1 << 20) + "apache\nlicense"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    n, places, _ = lic.Scanner(lic.PHRASES, lic.NOTICES).scan(text.encode())
    assert lic.folded(text.encode()) == " ".join(want)
    assert n == len(want) and places[-1] == ("apache", n - 2)
