import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from groundphrase.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{a:b}</style><script>var t="</p><article>";</script></head>
<body class="article"><header><h2>Site name</h2><a href=/>Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy this thing now.</div><div id="cookie-notice"><p>We use cookies on this site.</p></div>
<article><header><h1>Title &lt;here&gt;</h1></header><p><b>Lead&nbsp;text.<br>goes\n  on</b><p>Sh<i>or</i>t.<p>See <a href="x">this</a>, it is about a long and plain matter.
<ul><li>First point<li>Second point with a few words</ul><form><input value="x"><label>Your name</label></form><noscript><p>no</p></noscript>
<section class="comments"><h3>Comments</h3><p>I liked this article very much and say so at length.</p></section><blockquote>1 < 2 &amp;&amp; 3 &gt; 2</blockquote></article>
<aside><p>Other stories that may be of interest to you.</p></aside><footer>&copy; site &middot; all</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title <here>\nLead text. goes on\nShort.\nSee this, it is about a long and plain matter.\nFirst point\nSecond point with a few words\nno\n1 < 2 && 3 > 2"


def test_page_without_named_containers():
    page = "<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>A storm</h1>" + "".join(f"<p>{'word ' * n}</p>" for n in (40, 30, 60)) + "</div><div><a>more</a></div><div><a>about us</a></div>"
    assert H.main_text(page).split("\n") == ["A storm", *(("word " * n).strip() for n in (40, 30, 60))]


def test_broken_pages():
    assert H.main_text("") == "" and H.main_text("<article><<<>>") == "<<<>>"
    assert H.main_text("<article>plain text") == "plain text"
    assert H.main_text("<article><p>a</b></i></p><script>never closed <p>x") == "a"
    assert H.main_text("<article><p>x<select><option>y<p>z") .startswith("x")
    assert H.main_text("<p " * 2000 + ">") == "" and H.main_text("<article>" + "<b " * 3) == "<b <b <b"
    assert H.main_text('<article title="never closed><p>a</p>') == "a"
    assert H.main_text("<main>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</main>") == "deep"


@pytest.mark.parametrize("part", ["<svg>x", "<p ", '<p "', "<form><h1>", "<div>", "<script>", "<svg><script>", "</b>", "<!--", "<div></b>", "<b><p></p>", '<a class="', "<table><td>", "<textarea>", "&#", "<![CDATA["])
def test_a_megabyte_of_anything_takes_seconds(part):
    began = time.time()
    H.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 10


class Plain(HTMLParser):
    """Blocks by the standard library's parser, for pages that are well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.out, self.linked = [], [], [], 0

    def end(self):
        text = " ".join("".join(self.parts).split())
        if text:
            tags = [t for t, _ in self.stack]
            self.out.append((text, self.linked, bool(set(tags) & H.HEADINGS), self.stack[-1][1] if self.stack else H.UNKNOWN))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in H.BLOCK:
            self.end()
        if tag in H.VOID:
            return
        around = self.stack[-1][1] if self.stack else H.UNKNOWN
        spelled = " ".join(f'{k}="{v}"' for k, v in attrs)
        self.stack.append((tag, around if tag in ("body", "html") else H.said(tag, spelled, around)))

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.end()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in H.UNSEEN for t, _ in self.stack):
            self.parts.append(data)
            self.linked += len(data.split()) * any(t == "a" for t, _ in self.stack)


def brute(page):
    """The main text by the other parser, features counted one by one, and the tree walked by hand."""
    p = Plain()
    p.feed(page)
    p.close()
    p.end()
    bs, out = [(t, len(t.split()), k, h, c) for t, k, h, c in p.out], []
    for i, (text, n, k, heading, container) in enumerate(bs):
        row = [n, k / n]
        for j in (i - 1, i + 1):
            row += [bs[j][1], bs[j][2] / bs[j][1]] if 0 <= j < len(bs) else [0, 1.0]
        row += [heading, container]
        t = H.tree()
        while t.at is not None:
            t = t.low if row[t.at] <= t.cut else t.high
        if t.label:
            out.append(text)
    return p.out, "\n".join(out)


def test_blocks_and_their_choice_against_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rng = random.Random(8)
    for page in pages + [H.filled(x.replace("<li>", "</li><li>").replace("<ul></li>", "<ul>").replace("</ul>", "</li></ul>"), rng) for x in H.LAYOUTS if "<td>" not in x]:
        found, text = brute(page)
        assert [(b.text, b.linked, b.heading, b.container) for b in H.blocks(page)] == found
        assert H.main_text(page) == text


#: Layouts that the labelled table has not.
HELD_OUT = (
    "<p>{L1} | {L1} | {L2}</p><h1>{m5}</h1><p>{m60}</p><p>{m25}</p><p>{m90}</p><hr><p>{L3} | {L2}</p>",
    "<center><font>{L2} {L2}</font></center><table><tr><td><p>{m120}</p><p>{m60}</p></td><td>{L3}<br>{L4}</td></tr></table>",
    "<nav>{L1}{L1}</nav><article class='story search-result'><h1>{m7}</h1><p>{m23}</p><p>{m23}</p><p>{m23}</p><div class='share'>{L1} {L1}</div></article><div id=disqus_thread><p>{s44}</p></div>",
    "<header>{L2}</header><div class='blog-post'><div class='post-content'><p>{m40}</p><pre>{m30}</pre><p>{m12}</p></div><div class='post-tags'>{L1} {L1}</div></div><section id='comments'><ol><li class='comment'><article class='comment-body'><p>{s40}</p></article></li></ol></section><footer>{s8}</footer>",
    "<div id=wrap><div id=head><a href=/>{s2}</a></div><div id=nav>{L1} {L1} {L2}</div><div id=main><h2>{m6}</h2><p>{m35}</p><p>{m70} {K3}</p></div><div id=right><p>{L4}</p><p>{L5}</p></div><div id=foot>{s7} {L2}</div></div>",
)


def test_held_out_layouts():
    for layout in HELD_OUT:
        x, y = H.labelled_rows((layout,), 40, 5)
        right = [H.tree().predict(r) == label for r, label in zip(x.tolist(), y, strict=True)]
        assert sum(n for n, ok in zip(x[:, 0], right, strict=True) if ok) >= 0.95 * x[:, 0].sum(), layout


def test_everyday_names_and_forms_keep_the_article():
    article = "".join(f"<p>{'word ' * 23}</p>" for _ in range(4))
    for a, b in (('<div class="page-with-sidebar"><div class="content">', "</div></div>"), ('<div class="layout-header-fixed"><article>', "</article></div>"), ('<article class="post tags-politics">', "</article>"), ('<article class="story search-result">', "</article>"), ("<form action=x>", "</form>"), ("<form><div><input>", "</div></form>")):
        page = f"<nav><a href=x>to it</a></nav>{a}{article}{b}<footer>all rights held</footer>"
        assert H.main_text(page) == "\n".join(["word " * 22 + "word"] * 4), a
    assert H.main_text("<article><p>Some text here with words</p><p>so <math><mi>x</mi></math> is</p><noscript><p>kept</p></noscript></article>") == "Some text here with words\nso x is\nkept"


def test_words_and_links_of_neighbours_split():
    used, todo, first = set(), [(H.tree(), 0)], set()
    while todo:
        t, depth = todo.pop()
        if t.at is not None:
            used.add(H.FEATURES[t.at])
            first |= {H.FEATURES[t.at]} if depth < 2 else set()
            todo += [(t.low, depth + 1), (t.high, depth + 1)]
    assert first <= set(H.FEATURES[: H.TEXT]) and used & {"words before", "words after"} and used & {"links before", "links after"}, used


def test_tree_fits_its_table():
    x, y = H.labelled_rows(seed=77)  # fresh pages of the same layouts
    assert sum(H.tree().predict(r) == label for r, label in zip(x.tolist(), y, strict=True)) >= 0.97 * len(y)
    assert H.Tree(x[:1], y[:1]).predict(x[0]) == y[0]


def test_table(spark):
    """Against the articles of the given pages, cut out by their tags."""
    got = H.op8_html(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, None, "u", "t"), (None, "", None, None), (1, None, "u", "t"), (2, "<article>" + "x " * 500_000, "v", "t")], "page_id long, html string, url string, TEXT string")
    assert sorted((r.text or "", r.n_chars) for r in H.extract(df).collect())[:3] == [("", 0)] * 3
    assert H.extract(df.limit(0)).count() == 0
