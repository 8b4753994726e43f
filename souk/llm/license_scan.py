"""License scans: exact phrases, and fuzzy search for short license notices.

Texts are compared as words (A-Z in lower case; digits, letters and everything beyond ASCII)
parted by one space, so line breaks, comment marks and punctuation do not matter.

Phrases are found word for word. Notices are found with a bounded number of edits:

1. *Seeds.* A notice that may hold ``k`` edits is split into ``k + 1`` pieces of even length;
   by the pigeonhole principle every occurrence holds one piece unchanged, near its place.
   One automaton looks for all pieces of all notices (and the phrases) in one walk.
2. *Verification.* Each piece found names a window that any occurrence around it must lie
   in. The regex library's bounded-error matching looks for the notice in the window, part
   by part: names (mit, apache, gnu) must be exact, what surrounds them may have edits, and
   an occurrence starts and ends between words.
3. *Spans.* Of overlapping occurrences of a notice that with fewest edits stays. It is
   reported with its label, edits, words and code points in the text as it was given.

A window's verdict depends on its characters only, so a bounded memory of windows spares
passages that many documents share.

Defined results: null and empty texts, and texts without words, have no words, labels or
places and score 0; repeated rows and null ids are scanned each; bytes that are no UTF-8
count as one replacement character each in windows; an empty table gives no rows; extra
columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

# fixed values: phrases and their labels
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# fixed values: label and parts of each notice, a part with the edits it may hold
NOTICES = [
    ("mit", [("released under the ", 2), ("mit", 0), (" license", 1)]),
    ("mit", [("licensed under the ", 2), ("mit", 0), (" license", 1)]),
    ("mit", [("permission is hereby granted free of charge to any person obtaining a copy "
              "of this software and associated documentation files", 8)]),
    ("apache", [("licensed under the ", 2), ("apache", 0), (" license version 2 0", 2)]),
    ("apache", [("you may not use this file except in compliance with the license", 5)]),
    ("gpl", [("licensed under the ", 2), ("gnu", 0), (" general public license", 3)]),
    ("gpl", [("this program is free software you can redistribute it and or modify it under the terms of the ", 8),
             ("gnu", 0), (" general public license", 3)]),
    ("lgpl", [("under the terms of the ", 2), ("gnu lesser", 0), (" general public license", 3)]),
    ("agpl", [("under the terms of the ", 2), ("gnu affero", 0), (" general public license", 3)]),
    ("bsd", [("redistribution and use in source and binary forms with or without modification are permitted", 7)]),
    ("isc", [("permission to use copy modify and or distribute this software for any purpose with or without "
              "fee is hereby granted", 8)]),
    ("mpl", [("this source code form is subject to the terms of the ", 4), ("mozilla", 0), (" public license", 2)]),
    ("cc-by", [("licensed under ", 2), ("cc by", 0), (" 4 0", 0)]),
    ("cc-by-nc", [("licensed under ", 2), ("cc by nc", 0), (" 4 0", 0)]),
    ("cc-by-sa", [("licensed under ", 2), ("cc by sa", 0), (" 4 0", 0)]),
    ("cc-by", [("licensed under a creative commons ", 4), ("attribution", 0), (" 4 0 international license", 3)]),
    ("cc0", [("dedicated to the public domain under ", 4), ("cc0", 0)]),
    ("unlicense", [("this is free and unencumbered software released into the public domain", 6)]),
]

CACHE_WINDOWS = 50_000    # windows remembered by a scanner

# bytes as they count in words: A-Z in lower case, other ASCII than digits and letters parts words
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def pieces(text: str, n: int) -> list[tuple[int, str]]:
    """``(offset, piece)``: ``text`` in ``n`` pieces of even length."""
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(lo, text[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def folded(raw: bytes) -> str:
    """The words of a UTF-8 text, parted by one space."""
    parts = (b" ".join(part.split()) for part in slices(raw.translate(FOLDED)))
    return b" ".join(filter(None, parts)).decode("utf-8", "replace")


class Scanner:
    """Phrases and notices of whole texts."""

    def __init__(self, phrases, notices):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, []
        self.cache: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        found: dict[str, list] = {}
        for label, (phrase, _) in enumerate(phrases):
            found.setdefault(f" {phrase} ", []).append((label, None, 0))
        for at, (label, parts) in enumerate(notices):
            whole = "".join(text for text, _ in parts)
            edits = sum(k for _, k in parts)
            pattern = "".join(regex.escape(text) if not k else f"(?:{regex.escape(text)}){{e<={k}}}"
                              for text, k in parts)
            self.notices.append((label, len(whole), edits,
                                 regex.compile(rf"(?b)(?<![^ ]){pattern}(?![^ ])")))
            for offset, piece in pieces(whole, edits + 1):
                found.setdefault(piece, []).append((None, at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def scan(self, raw: bytes | None) -> tuple[int, list, list]:
        """Number of words, ``(label, word)`` of each phrase, and of each notice ``(label,
        first word, last word, start, end, edits, similarity)``."""
        norm = folded(raw or b"")
        if not norm:
            return 0, [], []
        text = f" {norm} "
        phrases: list[tuple[int, int]] = []
        windows: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            start = last - size + 1
            for phrase, notice, offset in uses:
                if notice is None:
                    phrases.append((start, phrase))
                else:
                    windows.add((start - offset, notice))
        places, at, word = [], 0, 0
        for start, phrase in sorted(phrases):
            word += text.count(" ", at, start)
            at = start
            places.append((self.phrases[phrase][1], word))
        n_words = norm.count(" ") + 1
        return n_words, places, self._verified(text, windows, raw) if windows else []

    def _verified(self, text: str, windows: set[tuple[int, int]], raw: bytes) -> list:
        hits: dict[int, set[tuple[int, int, int]]] = {}
        for start, notice in windows:
            _, size, edits, pattern = self.notices[notice]
            lo, hi = max(0, start - edits - 1), min(len(text), start + size + edits + 1)
            window = text[lo:hi]
            key = (notice, window)
            if key not in self.cache:
                if len(self.cache) >= CACHE_WINDOWS:
                    self.cache.clear()
                # a window's edge is no edge of a word
                m = pattern.search(f"\0{window}\0")
                ok = m is not None and m.start() > 0 and m.end() < len(window) + 2
                self.cache[key] = (m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)) if ok else None
            hit = self.cache[key]
            if hit:
                hits.setdefault(notice, set()).add((hit[2], lo + hit[0], lo + hit[1]))
        best = []
        for notice, spans in hits.items():
            label, size = self.notices[notice][:2]
            best += [(lo, hi, label, edits, 1 - edits / size) for edits, lo, hi in _apart(spans)]
        if not best:
            return []
        best.sort()
        before, at, spaces = {}, 0, 0       # spaces before each edge: one more than words
        for edge in sorted({x for lo, hi, *_ in best for x in (lo, hi)}):
            spaces += text.count(" ", at, edge)
            at, before[edge] = edge, spaces
        words = [(label, before[lo] - 1, before[hi] - 1, edits, share) for lo, hi, label, edits, share in best]
        spots = _spots(raw, {w for _, first, last, *_ in words for w in (first, last)})
        return [(label, first, last, spots[first][0], spots[last][1], edits, share)
                for label, first, last, edits, share in words]


def _apart(spans: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Those of ``(edits, start, end)`` that overlap none with fewer edits (then: an earlier
    one) that stays."""
    stay: list[tuple[int, int]] = []
    for edits, lo, hi in sorted(spans):
        at = bisect_left(stay, (lo,))
        if (at == 0 or stay[at - 1][1] <= lo) and (at == len(stay) or stay[at][0] >= hi):
            stay.insert(at, (lo, hi))
            yield edits, lo, hi


def _spots(raw: bytes, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Code points where the wanted words start and end in the text."""
    spots, at, points = {}, 0, 0
    place, words = 0, WORD.finditer(raw)
    for w in sorted(wanted):
        m = next(islice(words, w - place, None))
        place = w + 1
        points += len(raw[at:m.start()].decode("utf-8", "replace"))
        size = len(m[0].decode("utf-8", "replace"))
        spots[w] = (points, points + size)
        at, points = m.end(), points + size
    return spots


PLACES = "array<struct<label string, word long>>"
FOUND = ("array<struct<label string, first_word long, last_word long, start long, end long, "
         "edits int, similarity double>>")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> DataFrame:
    """``doc_id, n_words, places, notices``: every phrase's ``(label, word)`` and every
    notice's label, words, code points, edits and similarity, in text order."""

    @F.pandas_udf(f"n_words long, places {PLACES}, notices {FOUND}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for texts in batches:
            found = [scanner.scan(raw) for raw in texts]
            yield pd.DataFrame({
                "n_words": [n for n, _, _ in found],
                "places": [[{"label": a, "word": w} for a, w in p] for _, p, _ in found],
                "notices": [[dict(zip(("label", "first_word", "last_word", "start", "end", "edits", "similarity"), x))
                             for x in f] for _, _, f in found]})

    both = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text).cast("binary")).alias("s"))
    return both.select("doc_id", "s.n_words", "s.places", "s.notices")


def labels_and_score(found: DataFrame) -> DataFrame:
    """One digest row per document of :func:`license_scan`: ``doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score, spans``. The score is 1 with a phrase,
    else the highest similarity of a notice, else 0."""
    found = stored(found, "licenses")
    word = F.transform("places", lambda p: p["word"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("notices", lambda n: n["label"])
    score = F.when(F.size("places") > 0, 1.0).otherwise(
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["similarity"])), F.lit(0.0)))
    span = F.transform("notices", lambda n: F.concat_ws(
        ":", n["label"], n["start"].cast("string"), n["end"].cast("string"), n["edits"].cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        score.alias("score"), F.array_join(span, ",").alias("spans"))
