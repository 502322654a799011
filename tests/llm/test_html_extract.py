import json
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm.html_extract import Template, _page_tokens, extract, extract_page, parse, templates

NONE = Template(None)


def test_pages_alone():
    page = '<html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body><nav><li>menu</nav><!-- c <p>x</p> --><div class="ad">buy</div><header>site</header><article><h1>A &amp; B</h1><p>one  two<br>three<p><b>bo</b>ld &lt;x&gt; &#233;<div class="share">tweet</div><section id="comments"><p>me too</section><form>f</form><ul><li>i1<li>i2</ul></article><aside>s</aside><footer>&copy;</footer>'
    assert extract_page(page, NONE) == "A & B\n\none two three\n\nbold <x> é\n\ni1\n\ni2"
    assert extract_page("", NONE) == "" and extract_page("plain &amp; text", NONE) == "plain & text"
    assert extract_page("<div>a<div>b</div>c</div><script>never ends", NONE) == "a\n\nb\n\nc"
    assert extract_page('<p title="a>b">x</p><p>1 < 2</p><a href="q>open', NONE).startswith("x\n\n1 < 2")
    assert extract_page("<table><tr><td>a<td>b<tr><td>c</table>", NONE) == "a\n\nb\n\nc"
    assert extract_page("<p>" * 3000 + "deep" + "<div>" * 3000, NONE) == "deep"


def test_template(spark):
    """A host of bare divs: what repeats is template, what varies in the heavy slot is text."""
    rows = []
    for i in range(12):
        body = "".join(f"<div class='t'>Sentence number {i * 7 + k} about topic {i} goes on.</div>" for k in range(3 + i % 4))
        rows.append((i, f"http://soup.example/{i}", f"<html><body><div id='top'>Home News About</div><div class='m'><div>We value your time</div>{body}</div><div id='b'>All rights kept, number {i}</div></body></html>"))
    rows += [(20, None, None), (21, "http://one.example/x", "<body><main><p>Only page</p></main><p>other</p></body>"), (21, "http://one.example/x", ""), (22, "bad url", "<p>x</p>")]
    rows += [(30 + i, f"http://same.example/{i}", "<html><body><div>Same text on all pages</div></body></html>") for i in range(5)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    for limit in (32 << 20, -1):
        got = extract(df, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r.text for r in got if r.text or r.page_id != 21}
        for i in range(12):
            assert by[i] == "\n\n".join(f"Sentence number {i * 7 + k} about topic {i} goes on." for k in range(3 + i % 4)), by[i]
        assert by[20] == "" and by[21] == "Only page" and by[22] == "x" and by[32] == "Same text on all pages"
        assert all(r.n_chars == len(r.text) for r in got)
    assert extract(df.limit(0)).count() == 0


def test_embedded_elements_end_where_they_end():
    """Self-closed and unclosed icons, objects and canvases take no text with them."""
    icon = '<article><p>x <svg class="i"/> y</p><p>Second paragraph.</p>'
    assert extract_page(icon + "</article>", NONE) == "x y\n\nSecond paragraph."
    assert extract_page(icon + "<p>z<svg><title>no</title><text>no</text></svg></p></article>", NONE) == "x y\n\nSecond paragraph.\n\nz"
    assert extract_page("<article><p>a<svg/></p><svg><title/><g><text>no</text></g></svg><p>b</p></article>", NONE) == "a\n\nb"
    assert extract_page("<article><p>a <svg> no </p><p>b</p><svg><p>c</p></article>", NONE) == "a\n\nb\n\nc"
    for tag in ("object", "canvas", "iframe", "noscript", "template"):
        assert extract_page(f"<article><p>a</p><{tag} id='q'><p>b</p><p>c</p></article>", NONE) == "a\n\nb\n\nc", tag
        assert extract_page(f"<article><p>a</p><{tag} id='q' /><p>b</p><{tag}></{tag}></article>", NONE) == "a\n\nb", tag
    assert extract_page("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><object><p>instead</p></object><canvas>no</canvas></article>", NONE) == "a x=1\n\ninstead"


def test_wrappers_named_like_chrome():
    """What is named like chrome is none if it holds the text, and an article's parts are not readers' talk."""
    body = "<p>The first sentence of the text.</p><p>The second sentence of it.</p>"
    want = "The first sentence of the text.\n\nThe second sentence of it."
    for around in ("div class='layout has-sidebar'", "div id='page' class='header-fixed'", "form id='aspnetForm'", "div class='comments-open'"):
        tag = around.split()[0]
        for inner in (f"<article>{body}</article>", f"<div>{body}</div>", f"<main><div class='with-banner'>{body}</div></main>"):
            page = f"<body><a>Skip</a><{around}><nav>Home News</nav>{inner}<div class='sidebar'>see also</div></{tag}><footer>f</footer></body>"
            assert extract_page(page, NONE).removeprefix("Skip\n\n") == want, page
    parts = "<section class='related-work'><h2>Related work</h2></section><section id='discussion'><h2>Discussion</h2></section>"
    assert extract_page(f"<article>{body}{parts}<div class='related-posts'>no</div><div id='comments'>{'no ' * 40}</div></article>", NONE) == want + "\n\nRelated work\n\nDiscussion"
    assert extract_page(f"<main>{body}</main><aside><article>{body * 3} teaser</article></aside>", NONE) == want
    assert extract_page("<div class='sidebar'>left</div><div class='ad'>both</div><div class='ad'>last</div>", NONE) == "left\n\nboth\n\nlast"


def test_blanks_between_elements():
    assert extract_page("<article><p><b>a</b> <i>b</i>\n<a>c</a></p></article>", NONE) == "a b c"


def test_copies_are_no_template(spark):
    """Paragraphs shared by revisions of one article stay, on a small host and where copies are half of the pages."""
    rows, want = [], {}

    def add(i, host, parts):
        want[i] = "\n\n".join(parts)
        rows.append((i, f"http://{host}/{i}", "<body><div class='t'>Terms and conditions apply</div><div class='m'>" + "".join(f"<div>{p}</div>" for p in parts) + "</div></body>"))

    shared = [f"Paragraph {k} of the article that was revised, word {k * k}." for k in range(6)]
    for i in range(3):
        add(i, "few.example", [*shared, f"Revision {i} changed only this."])
    add(3, "few.example", [f"Another page says {k} things." for k in range(5)])
    for i in range(10, 30):
        parts = [f"Page {i} has its own sentence {k} here." for k in range(6)]
        add(i, "half.example", [*shared[: i % 6], f"Changed in {i}.", *shared[i % 6 + 1 :]] if i % 2 else parts)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in want:
        assert got[i].removeprefix("Terms and conditions apply\n\n") == want[i], (i, got[i])
    assert all(got[i] == want[i] for i in range(10, 30))


def test_template_within_articles(spark):
    """A notice in every article, an advert in some and text around teasers: the template tells, tags are hints."""
    rows, want = [], {}
    for i in range(12):
        parts = [f"Page {i} of this host has sentence {k} of its own." for k in range(5)]
        want[i] = "\n\n".join(parts)
        advert = "<div class='x'><i>Buy this lamp</i></div>" if i % 5 < 2 else ""
        rows.append((i, f"http://a.example/{i}", f"<article><p>We value your time</p>{advert}" + "".join(f"<p>{p}</p>" for p in parts) + "<p>Sign the petition</p></article>"))
        want[20 + i] = want[i]
        rows.append((20 + i, f"http://b.example/{i}", "<div class='m'>" + "".join(f"<p>{p}</p>" for p in parts) + f"</div><div class='more'><article>Teaser {i}</article></div>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_attributes_are_read_by_name():
    """A word in a value or after a hyphen is no attribute, and subjects are no chrome."""
    body = "<p>The first sentence of the text.</p><p>The second sentence of it.</p>"
    want = "The first sentence of the text.\n\nThe second sentence of it."
    for attrs in ('style="overflow: hidden"', 'title="the hidden cost"', 'data-hidden="false"', 'data-id="footer"', "data-class='sidebar' data-role=menu", 'class="social-science"', 'class="a" class="sidebar"', 'title=\'class="ad"\''):
        for tag in ("div", "section"):
            assert extract_page(f"<article><p>Lead.</p><{tag} {attrs}>{body}</{tag}><div class='share'>tweet</div></article>", NONE) == "Lead.\n\n" + want, attrs
    assert extract_page(f"<form method=post action=x><nav>menu</nav><article>{body}</article><input name=q></form>", NONE) == want
    assert extract_page(f"<article>{body}<div HIDDEN>no</div><div aria-hidden='true'>no</div></article>", NONE) == want


def test_readers_articles_go():
    body = "<p>The first sentence of the text.</p>"
    talk = "<article class='comment' id='comment-7'><p>I was there and saw all of it, believe me, it was great.</p></article>" * 3
    assert extract_page(f"<article>{body}</article>{talk}", NONE) == "The first sentence of the text."
    assert extract_page(f"<article>{body}<section>{talk}</section></article>", NONE) == "The first sentence of the text."
    assert extract_page(f"<main>{body}{talk}</main>", NONE) == "The first sentence of the text."
    assert extract_page(f"<article class='post comments-open'>{body}</article><p>x</p>", NONE) == "The first sentence of the text."


def test_classes_against_brute_force(spark):
    """Vectors kept as sums of hashes give the classes that whole vectors give, for a few small hosts."""
    rows = []
    for host in range(3):
        for i in range(9):
            extra = "".join(f"<div class='{c}'><b>{c}</b><i>t{i}</i></div>" for c, every in (("x", 2), ("y", 3), ("z", 2)) if (i + host) % every == 0)
            twice = "<ul><li>a<li>b</ul>" * (1 + i % 2) if host else ""
            rows.append((host * 100 + i, f"http://h{host}.example/{i}", f"<div id='t'>Top</div><div class='m'><p>Text {i} {host}</p>{extra}</div>{twice}"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    got = {r.host: json.loads(r.template) for r in templates(df, classes=True).collect()}
    for host in range(3):
        pages = [_page_tokens(h) for p, _, h in rows if p // 100 == host]
        vector, up = defaultdict(lambda: [0] * 9), {}
        for k, page in enumerate(pages):
            for (token, around, kind), s in page.items():
                if kind == 0:
                    vector[token][k] = s[0]
                    up[token] = around
        root = {t for t, v in vector.items() if v == [1] * 9}
        classes = defaultdict(set)
        for t, v in vector.items():
            if t not in root and sum(map(bool, v)) >= max(2, 0.3 * 9):
                classes[tuple(v)].add(t)

        def holder(t):
            while t is not None and t not in root:
                t = up.get(t)
            return t

        valid = [(next(iter(h)), c) for c in classes.values() if len(h := {holder(up[t]) for t in c}) == 1]
        found = got[f"h{host}.example"]["classes"]
        assert set(found[0]["tokens"]) == root and len(root) >= 3
        assert sorted((c["in"] or 0, sorted(c["tokens"])) for c in found[1:]) == sorted((h or 0, sorted(c)) for h, c in valid)


def test_repeats_clashing_columns_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>Line {i} of a very long page.</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://l.example/1", long, "h", "t", 3), (1, "http://l.example/1", long, "h", "t", 3), (None, None, "<p>x</p>", None, None, None)], "page_id long, url string, html string, host string, template string, n_chars int")
    got = extract(df).collect()
    assert sorted(r.n_chars for r in got) == [1, *[len("\n\n".join(f"Line {i} of a very long page." for i in range(30_000)))] * 2]


@pytest.mark.parametrize("piece", ["<b>", "<span><i></em>", "<b><p>", "<div><span>", "<svg><p><b>", "<option><li><td>", "</b></p>"])
def test_unclosed_tags_take_time_in_proportion(piece):
    page = "<html><body><article>" + piece * (1_000_000 // len(piece)) + "the text</article></body></html>"
    began = time.process_time()
    events = sum(1 for _ in parse(page))
    assert events > 1 and time.process_time() - began < 30
