"""Extraction against pages made from known articles, and odd markup."""

import html as references
import random
import re

import numpy as np
import pytest

from obsweave.llm import html_text, queries
from obsweave.llm.page_blocks import _INLINE, _VOID, DROP, MAIN, NAMED, OPEN, blocks


def article_text(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")
    return " ".join(references.unescape(inner).split())


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = {r.page_id: r for r in queries.op1_html_extraction(spark, sf_dir).collect()}
    assert len(rows) == len(pages)
    for page in pages:
        row = rows[page.page_id]
        assert row.url == page.url and row.text == article_text(page.html) and row.n_chars == len(row.text)


def test_markup():
    page = """<!DOCTYPE html><title>t</title><script>if (a<b) x="</p>"</script><header>top</header>
    <nav><ul><li><a href=/x>menu</a></ul></nav><div class="cookie-notice">ok?</div>
    <article class="post has-sidebar"><header>by line</header><h1>A &amp; B&nbsp;C</h1><p>one<b>two</b> three<br>four
    <p class=ad>buy<p>fi&shy;ve &#x41;&lt;i&gt;<!-- no <p> --><aside>side</aside><form><input value="a>b">send</form>
    <table><tr><td>x<td>y</table><figure><figcaption>cap</figcaption></figure>
    <section id="comments"><p>reader</section><div hidden>h</div><p>a < b</article><footer>end</footer>"""
    found = blocks(page)
    assert " ".join(t for z, t in found if z == MAIN) == "A & B C onetwo three four fi\xadve A<i> x y cap a < b"
    assert {t for z, t in found if z == DROP} >= {"top", "menu", "ok?", "by line", "buy", "side", "reader", "end"}
    assert blocks("plain <i>text</i>") == [(OPEN, "plain text")]
    assert blocks("<main><p>in</p></main><p>out") == [(MAIN, "in"), (DROP, "out")]
    assert blocks("<div role='main'>in</div>out") == [(MAIN, "in"), (DROP, "out")]
    assert blocks("") == blocks("<") [:0] == blocks("<!-- never closed") == blocks("<script>never closed")
    assert blocks("<p>unclosed <b>tag <article") != []


def test_raw_elements_end_where_they_end():
    texts = lambda page: " ".join(t for _, t in blocks(page))
    for name in ("svg-icon", "title-bar", "template-x", "object-list", "script-note"):
        assert texts(f"<p>a</p><{name} n=x></{name}><p>rest") == "a rest"
    for tag in ("<svg class=i/>", "<svg/>", '<SVG class="i" />'):
        assert texts(f"<p>a</p>{tag}<p>rest</p><svg><text>no</text></svg><p>end") == "a rest end"
    for name in ("svg", "object", "canvas", "iframe", "template"):
        assert texts(f"<p>a</p><{name} class=x><p>rest</p><{name}><p>end") == "a rest end"
        assert texts(f"<p>a</p><{name} class=x><b>no</b></{name.upper()} ><p>rest") == "a rest"
    for name in ("script", "style", "title", "textarea", "xmp", "noscript"):
        assert texts(f"<p>a</p><{name}><p>no") == "a"


def test_repeated_runs_fall_outside_articles(spark):
    menu = "home news sport travel weather contact about imprint legal"
    rows = [(i, f"http://a.b/{i}", f"<div>{menu}</div><p>page {i} says something of its own number {i}</p>") for i in range(6)]
    rows += [(10, "http://other/", f"<div>{menu}</div><p>only here</p>"), (11, None, None), (None, "http://a.b/x", "<p>no id</p>"), (12, "u", "")]
    rows += [(13, "http://a.b/y", f"<article>{menu} stays</article><div>{menu}</div>")] * 2
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, host string")
    found = sorted(((-1 if r.page_id is None else r.page_id, r.text) for r in html_text.main_text(pages).collect()), key=str)
    want = [(i, f"page {i} says something of its own number {i}") for i in range(6)]
    want += [(10, f"{menu} only here"), (11, ""), (-1, "no id"), (12, "")] + [(13, f"{menu} stays")] * 2
    assert found == sorted(want, key=str)
    assert html_text.main_text(pages.limit(0)).collect() == []


def main_texts(page):
    return " ".join(t for z, t in blocks(page) if z in (MAIN, NAMED))


@pytest.mark.parametrize("name", sorted(_INLINE - _VOID))
def test_inline_boilerplate_ends_where_it_ends(name):
    for word in ("related", "ad", "share", "comment", "newsletter"):
        mark = f'<{name} class="{word}">'
        assert main_texts(f"<article><p>a {mark}inline</{name}> b</p><p>c</p></article>") == "a b c"
        assert main_texts(f"<article><p>a {mark}in <{name}>x</{name}> y</{name}> b</p><p>c</p></article>") == "a b c"
        assert main_texts(f"<article><p>a {mark}in <{name} id=q>x</{name} ><u>y</u></{name}> b<p>c</article>") == "a b c"
        assert main_texts(f"<article><p>a {mark}one</{name}> b {mark}two</{name}> c</p>d</article>") == "a b c d"
        assert main_texts(f"<article>{mark}<div>no <p>no</p></div></{name}><p>c</p></article>") == "c"
        # Without an end tag it ends with its block, or with the next.
        assert main_texts(f"<article><p>a {mark}inline</p><p>c <{name}>d</{name}></p></article>") == "a c d"
        assert main_texts(f"<article><p>a {mark}inline<p>c</article>") == "a c"
        assert main_texts(f"<article>a {mark}inline<div>c</div> d</article>e") == "a c d"


def test_made_pages_by_brute_force():
    """Articles put together from known pieces, some of them boilerplate, in any nesting."""
    draw = random.Random(5)

    def piece(depth, tell):
        word = f"w{draw.randrange(10**6)}"
        kind = draw.randrange(6 if depth else 3)
        if kind == 0:
            return word, word if tell else ""
        if kind == 1:
            name, word_of = draw.choice(["span", "b", "em", "a", "i"]), draw.choice(["ad", "related", "share"])
            return f'<{name} class="{word_of}">{word}</{name}>', ""
        if kind == 2:
            return f"<b>{word}</b>", word if tell else ""
        inner = [piece(depth - 1, tell and kind != 5) for _ in range(draw.randrange(1, 4))]
        opened, closed = ("<p>", "</p>") if kind == 3 else ("<div>", "</div>") if kind == 4 else ("<aside>", "</aside>")
        if kind == 3:
            inner = [piece(0, tell) for _ in inner]
        return opened + " ".join(a for a, _ in inner) + closed, " ".join(t for _, t in inner if t)

    for _ in range(300):
        parts = [piece(3, True) for _ in range(4)]
        page = f"<nav>n</nav><article>{' '.join(a for a, _ in parts)}</article><footer>f</footer>"
        assert main_texts(page) == " ".join(" ".join(t for _, t in parts).split())


def test_names_inside_articles_need_repeats():
    """A class that may be about the article itself drops a block only if other pages repeat it."""
    for mark in ("p class=content-notice", "div class=promo-article", "h2 class=menu", "li class=social", "div class='article-header'"):
        tag = mark.split()[0]
        page = lambda i, text: blocks(f"<article><{mark}>{text}</{tag}><p>story {i} of this page</article>")
        assert list(html_text.unique_runs([page(i, f"says {i}") for i in range(4)])) == [f"says {i} story {i} of this page" for i in range(4)]
        assert list(html_text.unique_runs([page(i, "the same") for i in range(2)])) == [f"story {i} of this page" for i in range(2)]
        assert list(html_text.unique_runs([page(1, "the same")] * 3)) == ["the same story 1 of this page"] * 3


def test_what_articles_share_is_text():
    notice = "read all our terms and conditions before you go on"
    for n in (2, 19, 20, 30):
        pages = [[(MAIN, notice), (MAIN, f"text {i}")] for i in range(n)]
        assert list(html_text.unique_runs(pages)) == [f"{notice} text {i}" for i in range(n)]


def test_copies_are_one_page():
    story = "one story that many rows carry again and again"
    for zone in (MAIN, OPEN):
        copies = [[(DROP, f"menu {i} of some words that every page has {i % 3}"), (zone, story), (zone, "short end")] for i in range(30)]
        assert list(html_text.unique_runs(copies)) == [f"{story} short end"] * 30
        assert list(html_text.unique_runs([copies[0]] * 30)) == [f"{story} short end"] * 30


def test_near_copies_keep_their_text():
    body = " ".join(f"word{i}" for i in range(100))
    for n in (2, 40):
        pages = [[(OPEN, f"on day {i} of the month"), (OPEN, body)] for i in range(n)]
        assert list(html_text.unique_runs(pages)) == [f"on day {i} of the month {body}" for i in range(n)]


def test_chunks_do_not_show(spark, monkeypatch):
    draw = np.random.Generator(np.random.PCG64(2))
    word = lambda n: " ".join(f"w{i}" for i in draw.integers(0, 10**6, n))
    pair = [word(12) for _ in range(20)]  # each on two pages of 40 only
    rows = [(i, f"http://big/{i}", f"<div>{pair[i % 20]}</div><p>{word(9)}</p><p>end</p>") for i in range(40)]
    notice = word(4)
    rows += [(100 + i, f"http://news/{i}", f"<article><p class=top-menu>{notice if i in (3, 25) else word(4)}<p>{word(5)}</article>") for i in range(30)]
    rows += [(200 + i, "http://news/copy", rows[45][2]) for i in range(25)]
    rows += [(300, "http://big/copy", rows[3][2])] * 25 + [(400, "http://small/", rows[3][2]), (401, None, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = lambda: sorted((r.page_id, r.text) for r in html_text.main_text(pages).collect())
    want = texts()
    assert not any(p in t for i, t in want if i < 40 or i == 300 for p in pair)
    assert not any(notice in t for _, t in want)
    for size in (7, 3):
        monkeypatch.setattr(html_text, "CHUNK_PAGES", size)
        assert texts() == want


def test_repeats_by_brute_force():
    draw = np.random.Generator(np.random.PCG64(1))
    for _ in range(30):
        tokens = draw.integers(0, 3, 120).astype(np.uint64)
        page = np.sort(draw.integers(0, 4, 120))
        tokens[np.flatnonzero(np.diff(page))] = 100 + np.arange(len(np.flatnonzero(np.diff(page))))
        want = np.zeros(120, bool)
        for i in range(120 - html_text.LONG + 1):
            for j in range(i):
                if page[i] != page[j] and (tokens[i : i + 8] == tokens[j : j + 8]).all():
                    want[i : i + 8] = want[j : j + 8] = True
        assert (html_text.repeated(tokens, page) == want).all()
    assert list(html_text.unique_runs([])) == [] and list(html_text.unique_runs([[], [(OPEN, "a b c")]])) == ["", "a b c"]
