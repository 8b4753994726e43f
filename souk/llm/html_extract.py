"""Main text of HTML pages by two-pass block rules.

A tolerant scanner cuts a page into blocks (runs of text between block-level tags) and
drops regions that are never main text: scripts, styles, forms, navigation, headers,
footers, asides, hidden elements, and elements whose class, id or role names a menu, an
advert, a notice, a sidebar or comments. Names are taken whole, and of a compound name only
its last word counts (``site-sidebar``; plain boxes such as ``-area`` and numbers behind it
do not), never a modifier (``has-sidebar``, ``comments-open``, ``ad-free``). An element so
named stays if it holds at least ``LONG`` characters and most of the page's text outside
links, and no article or main region with as much lies outside it. A form is kept without its controls if it holds an
article or main region, or at least ``LONG`` characters and most of the page's text outside
links (pages that lie in one form as a whole).

Pass one labels each block by length, link density, stop-word density and region: long
blocks with running text are good, link-dense ones and ones without stop words bad, blocks
too short or too odd to tell stay undecided. Where the page marks article or main regions
(or names elements like one) that hold most of its text outside links, only blocks in them
are candidates. A region is a feature that spares what may be text: in it, a block without
any link is good from ``SHORT`` characters on, with or without stop words, and undecided
below; links that read as a sentence, headings, preformatted text and blocks with few links
and without stop words that are below ``LONG`` or end like a sentence stay undecided, and so
do all others without stop words if the regions' running text does not outweigh them (stop
words say nothing about languages that are not listed). Three link-dense blocks in a row in a
region are a menu and cut out.

Pass two gives undecided blocks the label of the nearest decided neighbour of their region;
inside an article or main region, one between a good and a bad block is good, and a heading
is good if a good block follows before the next heading of its rank. A region without any decided block
keeps its blocks.

Defined results: null and empty pages give an empty text; a page without text blocks
too; malformed and cut-off markup is read as far as it goes; repeated rows and null ids
are extracted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG, SHORT = 160, 60           # characters
LINK_DENSE = 0.5                # share of a block's characters inside links
PROSE, SOME_PROSE = 0.22, 0.08  # share of stop words among its words

STOP_WORDS = frozenset("""
the of and to in a is that it for was on are with as be by at this from or an not have he
der die das und ist nicht ein eine zu den von mit sich des auf im dem auch es als wie
le la les de des et est un une du dans que qui pour pas sur au avec il plus par ce
el los las y en del se por con no una su para es al lo como mas pero sus que un
""".split())

BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr
ul iframe video audio canvas
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("""
head nav footer aside button select option optgroup dialog menu iframe object canvas video
audio svg math map fieldset legend title
""".split())
FORM_TAGS = frozenset("label datalist output".split())      # dropped in forms only
DROPPED_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising adsbygoogle alert sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices sidebar comment comments commentlist disqus reply
replies menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing
social related recommended popup modal overlay newsletter subscribe subscription signup login
widget toolbar toc pager pagination copyright disclaimer complementary contentinfo
""".split())
CONTENT_NAMES = frozenset("article post entry content story title body main text".split())
# words of a compound name: what stands before or behind them is a state, no part of the page
MODIFIERS = frozenset("""
has no not non with without is are under open opened closed free left right top bottom enabled disabled
active inactive visible on off count policy page pages
""".split())
BOXES = frozenset("""
area bar block box column container inner item items links list outer panel row section slot unit
wrap wrapper
""".split())
REGIONS = frozenset(("article", "main"))
REGION_NAMES = frozenset("article post entry story content main".split())
MENU = 3                        # link-dense blocks in a row that make a menu inside an article

HEADING = re.compile("h[1-6]")
SENTENCE = re.compile(r"[.!?:…。！？؟।][\"'”’»)\]]*\Z")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|xmp)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.I | re.S)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?until)"
                    r"|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")


def _names(attrs: str) -> set[str]:
    """Words of an element's class, id and role."""
    return {w for m in NAMES.finditer(attrs)
            for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())} if attrs else set()


def _named(attrs: str) -> set[str]:
    """What the class, id and role names of an element say it is: the last word of each."""
    found = set()
    for m in NAMES.finditer(attrs):
        for name in CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
            while len(words) > 1 and words[-1] in BOXES:
                words.pop()
            if words and not MODIFIERS.intersection(words):
                found.add(words[-1])
    return found


KEPT, BY_NAME, DROPPED = range(3)


def _dropped(tag: str, attrs: str, in_region: bool) -> int:
    """Whether an element is no main text for what it is, or only by its name."""
    if tag in DROPPED_TAGS:
        return DROPPED
    if tag == "header" and not in_region:
        return DROPPED
    if not attrs or tag in ("html", "body", "main"):
        return KEPT
    if HIDDEN.search(attrs):
        return DROPPED
    found = _named(attrs) & DROPPED_NAMES
    if found and tag == "article":
        found &= {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"}
    elif found and _names(attrs) & CONTENT_NAMES:
        found -= {"header", "footer", "share", "social", "widget", "related", "menu"}
    return BY_NAME if found else KEPT


def blocks_of(page: str) -> list[tuple[str, int, int, str]]:
    """``(text, link characters, region, tag)`` of each kept block in page order.

    ``region`` numbers the article or main element the block lies in (0: none; negative:
    an element that is only named like one).
    """
    blocks: list[tuple[str, int, int, str]] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []    # (tag, dropped, region, named)
    text: list[str] = []
    linked = regions = links = forms = named = 0
    form_of: list[int] = []                     # per block the form it lies in (0: none)
    named_of: list[tuple[int, ...]] = []        # per block the elements around it that are dropped by name
    whole: set[int] = set()                     # forms that hold an article or main element
    tag_of = ""

    opened: Counter = Counter()                 # tags on the stack

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                blocks.append((words, linked, stack[-1][2] if stack else 0, tag_of))
                form_of.append(forms if opened["form"] else 0)
                named_of.append(stack[-1][3] if stack else ())
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        piece = m["text"]
        if piece is not None:
            if not (stack and stack[-1][1]):
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if links:
                    linked += len("".join(piece.split()))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID_TAGS and tag != "hr":
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if m["end"] or m["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            # an end tag closes what is open inside its element; an inline one no block
            while opened[tag] and (block or stack[-1][0] not in BLOCK_TAGS):
                if close() == tag:
                    break
            if block:
                links = 0 if tag != "li" else links
            tag_of = stack[-1][0] if stack else ""
            continue
        if tag == "hr" or attrs.endswith("/") and not block:
            continue
        # implied ends: a block start closes an open paragraph, an item its sibling
        if block:
            while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK_TAGS
                             or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close()
            links = 0
        outer = stack[-1] if stack else ("", False, 0, ())
        why = _dropped(tag, attrs, outer[2] > 0)
        drop = outer[1] or why == DROPPED or tag in FORM_TAGS and opened["form"] > 0
        region, around = outer[2], outer[3]
        if why == BY_NAME and not drop:
            named += 1
            around = (*around, named)
        if tag in REGIONS and not _dropped(tag, attrs, False):
            # an article cannot lie in a menu or advert: that one was never closed
            if (outer[1] or outer[3]) and not any(t in ("article", "dialog") or t == "form" and d
                                                  for t, d, _, _ in stack):
                drop, around = False, ()
                while stack and (stack[-1][1] or stack[-1][3]):
                    close()
            if not drop:
                if opened["form"]:
                    whole.add(forms)
                regions += 1
                region = regions if region <= 0 or tag == "article" else region
        elif not drop and not region and tag in ("div", "section", "td") and _names(attrs) & REGION_NAMES:
            regions += 1
            region = -regions
        if tag == "a":
            links += 1
        if tag == "form" and not opened["form"]:
            forms += 1
        if block or drop or around != outer[3]:     # other inline elements change nothing for what is in them
            stack.append((tag, drop, region, around))
            opened[tag] += 1
        tag_of = tag if block else tag_of
    flush()
    spared = _spared(blocks, named_of)
    stays = [spared.issuperset(chain) for chain in named_of]
    blocks = [b for b, stay in zip(blocks, stays) if stay]
    form_of = [f for f, stay in zip(form_of, stays) if stay]
    size = _unlinked(blocks)
    held: Counter = Counter()
    for form, n in zip(form_of, size):
        held[form] += n
    whole |= {form for form, n in held.items() if not form or n >= LONG and 2 * n >= sum(size)}
    return [b for b, form in zip(blocks, form_of) if form in whole]


def _spared(blocks: list[tuple[str, int, int, str]], named_of: list[tuple[int, ...]]) -> set[int]:
    """Elements dropped by name that hold most of the page's text outside links, and no article
    or main region of ``LONG`` characters lies outside them."""
    size = _unlinked(blocks)
    held: Counter = Counter()
    in_regions: Counter = Counter()
    for chain, n, (_, _, region, _) in zip(named_of, size, blocks):
        for element in chain:
            held[element] += n
            in_regions[element] += n if region else 0
    total, regions = sum(size), sum(n for n, b in zip(size, blocks) if b[2])
    return {e for e, n in held.items()
            if n >= LONG and 2 * n >= total and regions - in_regions[e] < LONG}


def _unlinked(blocks: list[tuple[str, int, int, str]]) -> list[int]:
    """Characters of each block outside links."""
    return [max(0, len(words.replace(" ", "")) - linked) for words, linked, _, _ in blocks]


def _link_dense(words: str, linked: int) -> bool:
    return linked > LINK_DENSE * len(words.replace(" ", ""))


def _label(words: str, linked: int, in_region: bool, tag: str) -> bool | None:
    """Pass one: good, bad or undecided. A region spares what may be text."""
    n = len(words)
    found = LETTERS.findall(words.lower())
    prose = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    spared = in_region and bool(HEADING.fullmatch(tag))
    if _link_dense(words, linked):      # a few words need a larger share to read as a sentence
        sentence = prose >= (PROSE if n >= SHORT else 2 * PROSE)
        return None if spared or in_region and sentence else False
    if n >= LONG and prose >= SOME_PROSE or n >= SHORT and (prose >= PROSE or in_region and not linked):
        return True
    if n < (LONG if in_region else SHORT) or spared or in_region and (tag == "pre" or SENTENCE.search(words)):
        return None
    return False if prose < SOME_PROSE else None


def _candidates(blocks: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """The blocks of the marked, else of all regions, if these hold most text outside links."""
    size = _unlinked(blocks)
    for inside in ([b[2] > 0 for b in blocks], [b[2] != 0 for b in blocks]):
        if any(inside) and 2 * sum(n for n, i in zip(size, inside) if i) >= sum(size):
            return [b for b, i in zip(blocks, inside) if i]
    return blocks


def main_text(page: str | None) -> str:
    """The main text, blocks joined by line ends."""
    blocks = _candidates(blocks_of(page or ""))
    n, kept = len(blocks), []
    menu, run = [False] * n, []
    for i, (words, linked, region, _) in enumerate(blocks):
        if not _link_dense(words, linked) or run and blocks[run[-1]][2] != region:
            run = []
        if _link_dense(words, linked):
            run.append(i)
            for j in run if len(run) == MENU else run[-1:] if len(run) > MENU else ():
                menu[j] = True
    # a menu inside an article is cut out like the dropped regions and lends nobody its label
    blocks = [b for b, m in zip(blocks, menu) if not (m and b[2])]
    n = len(blocks)
    labels = [_label(words, linked, region != 0, tag) for words, linked, region, tag in blocks]
    odd = [i for i, b in enumerate(blocks) if b[2] and labels[i] is False and not _link_dense(b[0], b[1])]
    if sum(len(blocks[i][0]) for i in odd) > sum(len(b[0]) for b, good in zip(blocks, labels) if b[2] and good):
        for i in odd:
            labels[i] = None
    before, after = [-1] * n, [n] * n           # nearest decided block of the same region
    for i in range(n):
        if i and blocks[i - 1][2] == blocks[i][2]:
            before[i] = i - 1 if labels[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        if blocks[i + 1][2] == blocks[i][2]:
            after[i] = i + 1 if labels[i + 1] is not None else after[i + 1]
    leads, text_at, heads = [False] * n, n, [n] * 7     # next good block, next heading by rank
    for i in range(n - 1, -1, -1):
        if i + 1 < n and blocks[i + 1][2] != blocks[i][2]:
            text_at, heads = n, [n] * 7
        if HEADING.fullmatch(blocks[i][3]):
            rank = int(blocks[i][3][1])
            leads[i] = text_at < heads[rank]
            heads[rank:] = [i] * (7 - rank)
        if labels[i]:
            text_at = i
    for i, (words, _, region, tag) in enumerate(blocks):
        good = labels[i]
        if good is None:
            left, right = before[i], after[i]
            if left < 0 and right >= n:
                good = True
            elif region and leads[i]:
                good = True
            elif region and left >= 0 and right < n:
                good = labels[left] or labels[right]
            elif left < 0 or right < n and right - i < i - left:
                good = labels[right]
            elif right >= n or i - left < right - i:
                good = labels[left]
            else:                               # between two: a heading belongs to what follows
                good = labels[right] if HEADING.fullmatch(tag) else labels[left] or labels[right]
        if good:
            kept.append(words)
    return "\n".join(kept)


def text_column(html: str) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return extract(F.col(html))


def extract_text(pages: DataFrame, html: str = "html", page_id: str = "page_id",
                 url: str = "url") -> DataFrame:
    """``page_id, url, text`` for every page."""
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        text_column(html).alias("text"))
