"""Page operators against brute force, and their defined results for awkward rows."""

import base64
import collections
import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from souk.llm import html_extract, url_filter, warc
from souk.llm.common import shared_path
from souk.llm.registry import URL_RULES

PROSE = "The cat is on the mat and it was happy with the dog in the house of the king for a long time. "


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", "f", "r") for i, u, h in rows],
                                 "page_id long, url string, html string, sha string, first string, rule string")


# ---- main text ----------------------------------------------------------------------

def test_article_without_its_surroundings():
    page = (f"<html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p><article>';</script></head><body>"
            f"<header><p>{PROSE}</p></header><nav><ul><li><a href='/x'>Home</a></li></ul></nav><!-- x > <p>y -->"
            f"<div class='cookie-notice'><p>{PROSE}</p></div><article><h1>A &amp; B&nbsp;&lt;C&gt;</h1>"
            f"<p><b>{PROSE}<br><p>E<i>f</i>g  h\n i.</p><div class=\"ad\">{PROSE}</div><form><p>{PROSE}</p></form>"
            f"<p>No words</p><aside>{PROSE}</aside></article><section id='comments'><p>{PROSE}</p></section>"
            f"<footer>&copy; {PROSE}</footer></body></html>")
    assert html_extract.main_text(page) == "\n".join(["A & B <C>", PROSE.strip(), "Efg h i.", "No words"])


def test_bare_pages_follow_the_density_rules():
    links = "".join(f"<a href='/{i}'>Section number {i}</a> " for i in range(9))
    page = f"<body><div>{links}</div><h2>Head</h2><p>{PROSE * 2}</p><p>Ok.</p><p>{PROSE}</p><div>{links}</div><p>Top</p></body>"
    assert html_extract.main_text(page).split("\n") == [
        "Head", (PROSE * 2).strip(), "Ok.", PROSE.strip()]
    named = f"<div class='post-content'><p>{PROSE}</p><p>Ok.</p></div><div>Printed in the town</div>"
    assert html_extract.main_text(named) == f"{PROSE.strip()}\nOk."


def test_links_inside_an_article():
    items = "".join(f"<li><a href='/{i}'>Menu item {i}</a></li>" for i in range(4))
    page = (f"<article><h1>Head</h1><ul>{items}</ul><p>{PROSE}</p><p><a href='/s'>Source of the text</a></p>"
            f"<ul><li>One</li><li>Two</li></ul><blockquote>Quoted</blockquote></article>")
    assert html_extract.main_text(page).split("\n") == ["Head", PROSE.strip(), "Source of the text", "One", "Two", "Quoted"]
    assert html_extract.main_text(f"<p>Above</p><div role='main'><p>{PROSE}</p></div>") == PROSE.strip()


def test_density_rules_decide_inside_an_article():
    words = " | ".join(f"Word{chr(97 + i)}" for i in range(26))
    share = "Share: <a href='/f'>Facebook</a> <a href='/t'>Twitter</a>"
    page = (f"<article><h1>Head</h1><p>By <a href='/j'>Jane Doe</a></p><h2>Sub</h2><p>{PROSE * 6}</p><p>{share}</p><p>{words}</p>"
            f"<p>{PROSE}</p><p>Ok.</p><p>{words}</p><p>Tags</p><p>{share}</p></article>")
    # link-dense blocks and short lines beside them go; an unlinked paragraph is the article's text
    assert html_extract.main_text(page) == "\n".join(
        ["Head", "Sub", (PROSE * 6).strip(), words, PROSE.strip(), "Ok.", words, "Tags"])
    # an article that holds little of the text is no region, its blocks are judged like all
    card = "<article><h3>Card</h3><p>Of the day.</p></article>"
    assert html_extract.main_text(f"{card}<div><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div>") == "\n".join(
        ["Card", "Of the day."] + [(PROSE * 3).strip()] * 2)


WRAPPERS = [
    "<article class='post comments-open'>", "<div id='content' class='has-sidebar'>", "<div id='main' class='no-sidebar'>",
    "<div class='content sidebar-right'>", "<div class='entry-content ad-free'>", "<div class='page-with-toc'>",
    "<div class='post-body promo'>", "<div class='wrapper menu-open'>", "<div class='article-body has-ads'>",
    "<section class='social-policy'>", "<div class='siteNavOpen'>", "<div class='notice'>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_modifiers_and_majority_keep_a_page(wrapper):
    end = f"</{wrapper[1:].split()[0]}>"
    body = f"<h1>Head</h1><p>{PROSE * 4}</p><p>{PROSE * 3}</p>"
    page = f"<nav><a href='/'>Home</a></nav>{wrapper}{body}{end}<footer>{PROSE}</footer>"
    assert html_extract.main_text(page).split("\n") == ["Head", (PROSE * 4).strip(), (PROSE * 3).strip()]


@pytest.mark.parametrize("name", ["site-sidebar", "main-nav", "comments-area", "ad-slot", "ad-300x250", "widget_2",
                                  "siteFooter", "cookie-banner", "newsletter-signup", "comment-list", "sidebar"])
def test_named_surroundings_go_even_if_longer_than_the_article(name):
    body = f"<h1>Head</h1><p>{PROSE * 4}</p>"
    aside = f"<div class='x {name}'>" + f"<p>{PROSE * 9}</p>" * 3 + "</div>"
    for page in (f"<article>{body}</article>{aside}", f"{aside}<div class='post-content'>{body}</div>",
                 f"<article>{body}{aside}</article>"):
        assert html_extract.main_text(page).split("\n") == ["Head", (PROSE * 4).strip()], page[:60]


class _Article(HTMLParser):
    """Blocks of the one article of a generated page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip += tag in ("script", "style") or dict(attrs).get("class") == "ad"
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "article", "blockquote"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "article", "blockquote"):
            self.blocks.append("")
        self.skip = max(0, self.skip - (tag in ("script", "style", "div")))
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_all_blocks_of_all_articles_come_out():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    assert len(pages) == 2500
    for i, page in enumerate(pages):
        parser = _Article()
        parser.feed(page or "")
        parser.close()
        want = [w for w in (" ".join(b.split()) for b in parser.blocks) if w]
        assert html_extract.main_text(page).split("\n") == (want or [""]), i


def test_stop_words_judge_no_article_in_another_language():
    other = "Кошка сидела возле дома рядом с собакой короля долгое время. " * 4
    page = f"<article><h1>Кошка</h1><p>{other}</p><p>{PROSE}</p><p>{other}</p><pre>{'x = y + z ' * 30}</pre></article>"
    assert html_extract.main_text(page).split("\n") == [
        "Кошка", other.strip(), PROSE.strip(), other.strip(), ("x = y + z " * 30).strip()]


def test_a_form_around_the_page_is_no_dropped_region():
    controls = "<select><option>One</option></select><label>Name</label><button>Go</button><textarea>x</textarea>"
    body = f"<nav><a href='/'>Home</a></nav>{controls}<h1>Head</h1><p>{PROSE * 4}</p><p>Ok.</p>"
    want = ["Head", (PROSE * 4).strip(), "Ok."]
    for inner in (f"<article>{body}</article>", f"<div>{body}</div>", f"<div><nav><ul><li>x<article>{body}</article></div>"):
        page = f"<body><form id='aspnetForm' method='post'>{inner}</form><footer>{PROSE}</footer></body>"
        assert html_extract.main_text(page).split("\n") == want, inner
    body = body.replace(controls, "")
    login = f"<form action='/in'><p>User</p><p>{PROSE}</p>{controls}</form>"
    assert html_extract.main_text(f"{login}<article>{body}</article>{login}").split("\n") == want
    assert html_extract.main_text(f"<div>{body}</div>{login}").split("\n") == want
    assert html_extract.main_text(login) == ""


def test_broken_markup_and_empty_pages():
    cases = {None: "", "": "", "plain": "plain", "<p>a<p>b": "a\nb", "<p>a <b>b": "a b", "<p": "", "a < b": "a < b",
             "<script>x": "", "<p title='a>b'>c</p>": "c", "<p title='a>c</p>": "c", "<nav><ul><li>x<article><p>y": "y",
             "<div hidden>x</div>y": "y", "<td>a</td><td>b</td>": "a\nb", "&#65;&am &amp": "A&am &".replace("A&", "A&")}
    for page, want in cases.items():
        assert html_extract.main_text(page) == want, page
    assert html_extract.main_text("<a>" * 5000 + "<div>" * 5000 + "x") == "x"
    assert html_extract.main_text("<b>" * 90000 + "x" + "</i>" * 90000) == "x"        # in linear time


def test_extraction_query_shape(spark):
    rows = [(1, "u", None), (1, "u", "<p>a"), (None, None, "<p>b"), (2, "u", "<article><p>c\t d</article>")]
    got = html_extract.extract_text(_pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("1", "a"), ("2", "c d"), ("None", "b")]
    assert html_extract.extract_text(_pages(spark, [])).collect() == []


# ---- archives -----------------------------------------------------------------------

def _expected(rows, least):
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and key is not None:
            first[body] = min(first.get(body, key), key)
    out = collections.Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        leader = first.get(body) if len(body) >= least else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = leader is not None and leader != key
        out[key, len(body), digest, "revisit" if revisit else "response", leader if revisit else None] += 1
    return out


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 9000)        # several archives per task
    rows = [(i, f"http://h/{i}", f"<p>{'page text é ' * (i % 9)}{i % 13}</p>") for i in range(120)]
    rows += [(200, None, None), (201, "a\r\nb", ""), (202, "ü", ""), (5, "again", rows[5][2]), (5, "again", rows[5][2]),
             (2 ** 62 + 1, "big", "big"), (2 ** 62 + 3, "big", "big"), (None, "n", "only here"), (None, "n", rows[7][2]), (300, "x", "long " * 4000)]
    for least in (0, 20):
        pages = _pages(spark, rows).repartition(3)
        folder = shared_path(spark, "warc-test")
        done = warc.write_archives(pages, folder, least_bytes=least)
        got = warc.read_archives(spark, folder, done).collect()
        assert done.count() > 3 and sum(r.records for r in done.collect()) == len(rows)
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                                   for r in got) == _expected(rows, least)
        for r in got:
            assert (r.payload is None) == (r.record_type == "revisit")
    empty = warc.archive_pages(_pages(spark, []))
    assert empty.collect() == []


def test_unreported_archives_are_not_read(spark):
    folder = shared_path(spark, "warc-test")
    done = warc.write_archives(_pages(spark, [(1, "u", "a"), (2, "u", "b")]).coalesce(1), folder)
    warc.write_archives(_pages(spark, [(1, "u", "a")]).coalesce(1), folder)      # as a second attempt would
    assert sorted(r.page_id for r in warc.read_archives(spark, folder, done).collect()) == [1, 2]


def test_each_record_is_a_frame_behind_the_dictionary():
    import io

    import zstandard

    out, records = io.BytesIO(), [warc.make_record(i, "u", b"payload %d" % i, None) for i in range(3)]
    writer = warc.ArchiveWriter(out, records)
    for r in records:
        writer.write(r)
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    trained = zstandard.ZstdCompressionDict(data[8:8 + size])
    assert zstandard.ZstdDecompressor(dict_data=trained).decompress(data[8 + size:]) == records[0]
    assert [r["x-page-id"] for r in warc.read_archive(data)] == ["0", "1", "2"]


# ---- URLs ---------------------------------------------------------------------------

def _judge(url, rules, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, None))
    canon = host + path.rstrip("/")
    return host, path, best[2], best[3] or ("block" if canon and canon in listed else "allow")


def test_rules_then_list(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://example.com/en/1",
            "https://www.Example.com/en/1?x://y", "https://x.www.example.com/en/", "http://example.com/En/", "http://b.net/es/1",
            "http://b.net/es", "ftp://net/fr/#", "http://notcom/", "http://x.org/p/", "http://x.org/p?q", "http://x.org/p/q",
            "https://X.org/p//", "http://xcom/", "http://a.com:80/"] + [f"http://bulk.org/{i}" for i in range(400)]
    listed = ["http://x.org/p/", None, "", "http://b.net/es", "http://a.com/"] + [f"ftp://bulk.org/{i}/" for i in range(0, 400, 3)]
    frame = spark.createDataFrame([(u,) for u in listed + listed[:2]], "url string")
    keys = {c for u in listed if u for h, p, _, _ in [_judge(u, [], set())] for c in [h + p.rstrip("/")] if c}
    pages = _pages(spark, [(i, u, "h") for i, u in enumerate(urls)] + [(5, urls[5], "h"), (None, urls[6], "h")])
    want = {(i, u): _judge(u, URL_RULES, keys) for i, u in enumerate(urls)}
    for blocks in (1 << 19, 1):                 # one block: the filter passes nearly all, the join decides
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
        got = url_filter.judge(pages, URL_RULES, frame).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == (
                _judge(urls[6], URL_RULES, keys) if r.page_id is None else want[r.page_id, urls[r.page_id]])
    nothing = url_filter.judge(pages, URL_RULES, frame.limit(0)).where("rule is null and verdict = 'block'")
    assert nothing.count() == 0
    assert url_filter.judge(_pages(spark, []), URL_RULES, frame).collect() == []


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) AS url")
    words = url_filter.build_filter(listed, 3000)
    shared = spark.sparkContext.broadcast(words)
    test = spark.range(9000).selectExpr("id", "concat('h/', id) AS url")
    got = test.select("id", url_filter.may_be_listed(test["url"], shared, len(words)).alias("m")).where("m").collect()
    ids = np.array([r.id for r in got])
    assert (ids < 3000).sum() == 3000 and (ids >= 3000).sum() < 120
