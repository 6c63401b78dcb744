"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each is described by its word count and link density, those of its
neighbours, whether it is a heading, and what its nearest telling container is. A decision tree, trained here on a
small labelled table of pages, tells main text from the rest; words and link densities of the block and its
neighbours split first, so that no name decides alone. Nothing else is dropped or cut.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from groundphrase.llm.common import map_text, table

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile("[>\"']")
HINTS = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
UNSEEN = frozenset("script style template title svg iframe object canvas audio video select textarea button datalist form input head".split())
#: Of these, those that hold text only, up to their own end.
RAW = frozenset("script style textarea title iframe template".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Starts and ends of the others, and of what may hold such by chance.
REGION = re.compile(rf"<(/?)({'|'.join(sorted(UNSEEN - RAW - VOID))}|script|style)(?=[\s/>])", re.I)
#: Text between tags. A form with fewer words holds its fields and their names; one with more is around the page's text.
BETWEEN = re.compile(r">([^<]+)")
FORM_WORDS = 40
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element in the first set ends an open one in the second, up to the nearest other block.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN_TAGS, SIDE_TAGS = frozenset(("article", "main")), frozenset("nav aside footer menu dialog search".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())
#: Names of containers that aren't main text whatever they hold, and names that say so unless an article stands inside.
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr newsletter pager pagination popular promo promotion recommended related replies reply respond share sharing social sponsor sponsored subscribe".split()
)
SIDE_NAMES = frozenset("banner bar contentinfo copyright discussion footer header legal login masthead menu modal nav navbar navigation notice notices popup search sidebar signup skip tags teaser toolbar topbar trending warning widget".split())
#: Parts of a name that say what a container has or lacks, not what it is.
HAVING = frozenset("with without has have no not js is".split())
#: What the nearest telling container says.
MAIN, UNKNOWN, SIDE, NEVER = -1, 0, 1, 2


@dataclass
class Block:
    """A block: its text, words, words in links, heading or not, and what its container says (MAIN to NEVER)."""

    text: str
    words: int
    linked: int
    heading: bool
    container: int


class _Scan:
    """One pass over a page's markup. Nothing is looked for twice: what is known to be missing is remembered."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.none: dict[str, int] = {}  # a string isn't there from this place on
        self.quoted = True  # until a tag is found whose quotes don't end
        self._regions: dict | None = None
        self._texts: list | None = None

    def find(self, what: str, at: int) -> int:
        """str.find; a second search for what is missing costs nothing."""
        if self.none.get(what, self.n + 1) <= at:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none[what] = min(at, self.none.get(what, at))
        return k

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, past quoted values; -1 if there is none."""
        if self.quoted:
            k = at
            while (m := STOPS.search(self.page, k)) is not None:
                if m[0] == ">":
                    return m.start()
                k = self.find(m[0], m.end()) + 1
                if k == 0:
                    break
            self.quoted = False  # from here on quotes mean nothing, so this is the only search in vain
        return self.find(">", at)

    def token(self, at: int) -> tuple[str, int, str, str]:
        """(kind, end, text or tag, attributes): kinds are text, open, close and none (comments and the like)."""
        page = self.page
        if page[at] != "<":
            end = self.find("<", at)
            end = self.n if end < 0 else end
            return "text", end, page[at:end], ""
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return "none", self.n if end < 0 else end + 3, "", ""
        if page.startswith("<![CDATA[", at):
            end = self.find("]]>", at + 9)
            return "raw", self.n if end < 0 else end + 3, page[at + 9 : self.n if end < 0 else end], ""
        if page.startswith(("<!", "<?"), at):
            end = self.find(">", at + 2)
            return "none", self.n if end < 0 else end + 1, "", ""
        m = NAME.match(page, at + 1)
        end = self.tag_end(m.end()) if m else -1
        if end < 0:
            return "text", at + 1, "<", ""
        return "close" if m[1] else "open", end + 1, m[2].lower(), page[m.end() : end]

    def region_end(self, start: int, tag: str) -> int:
        """The end of the element that is open since `start` (the place after its name), -1 if it is never closed."""
        if self._regions is None:
            self._regions, stacks, at = {}, {}, 0
            while (m := REGION.search(self.page, at)) is not None:
                at, name = m.end(), m[2].lower()
                if name in ("script", "style"):
                    if not m[1]:
                        at = self.raw_end(at, name) if self.raw_end(at, name) >= 0 else at
                elif not m[1]:
                    stacks.setdefault(name, []).append(at)
                elif stacks.get(name):
                    end = self.find(">", at)
                    self._regions[stacks[name].pop()] = self.n if end < 0 else end + 1
        return self._regions.get(start, -1)

    def words_between(self, start: int, end: int) -> int:
        """Words between tags in a part of the page, by running sums that are made once."""
        if self._texts is None:
            self._texts, self._words = [], [0]
            for m in BETWEEN.finditer(self.page):
                self._texts.append(m.start())
                self._words.append(self._words[-1] + len(m[1].split()))
        return self._words[bisect_left(self._texts, end)] - self._words[bisect_left(self._texts, start)]

    def raw_end(self, at: int, tag: str) -> int:
        """The end of raw text: after </tag>, -1 if it is missing."""
        key = "</" + tag
        if self.none.get(key, self.n + 1) <= at:
            return -1
        m = RAW_END[tag].search(self.page, at)
        if m is None:
            self.none[key] = min(at, self.none.get(key, at))
            return -1
        return m.end()

    def skip(self, start: int, at: int, tag: str) -> int:
        """Where an element without text ends. One that is never closed ends at once, but raw text at the page's
        end. A form around more text than fields need is not skipped."""
        if tag in RAW:
            end = self.raw_end(at, tag)
            return self.n if end < 0 else end
        end = self.region_end(start, tag)
        if end < 0 or tag == "form" and self.words_between(at, end) >= FORM_WORDS:
            return at
        return end


def said(tag: str, attrs: str, around: int) -> int:
    """What a container says of what is in it, inside one that says `around`. Of a name with several parts the last one
    tells what it is, the first one what it belongs to; a name of what it has tells nothing."""
    tokens: set[str] = set()
    for m in HINTS.finditer(attrs):
        tokens.update((m[2] or m[3] or m[4] or "").split())
    never = side = main = False
    for token in tokens:
        parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if x]
        if not parts or HAVING & set(parts):
            continue
        never = never or parts[0] in NEVER_NAMES or parts[-1] in NEVER_NAMES
        sides = SIDE_NAMES - {"header"} if around == MAIN else SIDE_NAMES
        if parts[-1] in sides or parts[0] in sides and not MAIN_NAMES & set(parts):
            side = True
        elif MAIN_NAMES & set(parts):
            main = True
    if around == NEVER or never and not (tag in MAIN_TAGS and main and not {"comment", "comments", "reply"} & {x for t in tokens for x in re.split("[^a-z]+", t.lower())}):
        return NEVER
    if tag in MAIN_TAGS:
        return MAIN
    if tag in SIDE_TAGS or tag == "header" and around != MAIN or side and not main:
        return SIDE
    return SIDE if around == SIDE else MAIN if main else around


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. References are decoded, white space in a block is one space. Time is
    linear in the page, whatever is broken in it."""
    scan, out = _Scan(page), []
    stack: list[tuple[str, int]] = []  # tag, what it says
    opened: dict[str, list[int]] = {}  # places of each open tag in the stack
    walls: list[int] = []  # places of the open blocks
    parts: list[str] = []
    linked = links = heading = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, len(text.split()), linked, heading > 0, stack[-1][1] if stack else UNKNOWN))
        parts.clear()
        linked = 0

    def pop(k: int) -> None:
        """Close all open elements from the k-th on."""
        nonlocal links, heading
        while len(stack) > k:
            tag, _ = stack.pop()
            opened[tag].pop()
            if tag in BLOCK:
                walls.pop()
            links -= tag == "a"
            heading -= tag in HEADINGS

    at = 0
    while at < scan.n:
        start = at
        kind, at, tag, attrs = scan.token(at)
        if kind in ("text", "raw"):
            text = html.unescape(tag) if kind == "text" else tag
            parts.append(text)
            if links and kind == "text":
                linked += len(text.split())
        elif kind == "open" and tag == "br":
            parts.append(" ")
        elif kind == "close":
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCK:
                end_block()
            if opened.get(tag):
                depth = opened[tag][-1]
                if tag in BLOCK or not walls or walls[-1] <= depth:  # a stray end of an inline element doesn't close blocks
                    pop(depth)
        elif kind == "open" and tag in UNSEEN:
            if tag not in VOID:
                if tag in BLOCK or tag == "head":
                    end_block()
                at = scan.skip(start + 1 + len(tag), at, tag)
        elif kind == "open":
            if tag in BLOCK:
                end_block()
                if walls and stack[walls[-1]][0] in CLOSES.get(tag, {"p"} if tag not in ("body", "html") else ()):
                    pop(walls[-1])
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            around = stack[-1][1] if stack else UNKNOWN
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                walls.append(len(stack))
            stack.append((tag, around if tag in ("body", "html") else said(tag, attrs, around)))
            links += tag == "a"
            heading += tag in HEADINGS
    end_block()
    return out


#: What a row of described() holds; the first TEXT of them come from words and links alone.
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "container")
TEXT = 6


def described(bs: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of it, the one before and the one after; heading, container."""
    if not bs:
        return np.zeros((0, len(FEATURES)))
    w, d = np.array([[b.words, b.linked / b.words] for b in bs], float).T
    before, after = np.r_[0, w[:-1]], np.r_[w[1:], 0]
    d0, d1 = np.r_[1.0, d[:-1]], np.r_[d[1:], 1.0]
    return np.c_[w, d, before, d0, after, d1, [[b.heading, b.container] for b in bs]]


#: The labelled table: layouts of pages. {m40} stands for some 40 words of main text and {s9} for nine others, {L2} and
#: {K2} for links of such. Names are left out or mislead in some, as they do on the web.
LAYOUTS = (
    "<header><b>{s2}</b>{L1}</header><nav><ul><li>{L1}<li>{L1}<li>{L2}</ul></nav><article><h1>{m8}</h1><p>{m40}</p><p>{m3}</p><p>{m90} {K2}</p><h2>{m3}</h2><p>{m25}</p></article><footer><p>{s12}</p></footer>",
    "<nav><ul><li>{L1}</li><li>{L1}</li><li>{L2}</li></ul></nav><div class=ad>{s9}</div><article><h1>{m9}</h1><p>{m60}</p><p>{m2}</p><p>{m7}</p><p>{m120}</p></article><footer>{s9}<br>{s3}</footer>",
    "<nav><ul><li>{L1}</li><li>{L2}</li></ul></nav><div class=ad>{s8}</div><article><h1>{m1}</h1><p>{m1}</p><p>{m4}</p></article><footer>{s8}</footer>",
    "<div>{L1} {L2} {L1}</div><div><h1>{m7}</h1><p>{m55}</p><p>{m80} {K3}</p><p>{m35}</p><p>{m9}</p><p>{m44}</p></div><div>{L4}</div><div>{L3}</div><div>{s6} {L2}</div>",
    "<table><tr><td>{L2}<br>{L2}<br>{L1}</td><td><h1>{m6}</h1><p>{m70}</p><p>{m30}</p><p>{m20} {K4}</p></td></tr></table><p>{L2} {L2}</p>",
    "<div class=page-with-sidebar><div class=content><h1>{m8}</h1><p>{m23}</p><p>{m23}</p><p>{m23} {K2}</p></div><div class=sidebar><h3>{s2}</h3><p>{s30}</p><ul><li>{L4}<li>{L5}</ul></div></div><div>{s5} {L2}</div>",
    "<div id=top>{L1} {L1} {L1}</div><main><h1>{m8}</h1><p>{m100}</p><p>{m40}</p><div class=comments><h3>{s2}</h3><p>{s40}</p><p>{s60}</p><p>{s8}</p></div></main><footer><p>{s9}</p><p>{L2} {L3}</p></footer>",
    "<div class=menu><a href=x>{s1}</a></div><section class=post><h1>{m6}</h1><p>{m15} {K15}</p><ul><li>{m6}<li>{m9}<li>{m7} {K2}</ul><blockquote>{m30}</blockquote><table><tr><td>{m2}<td>{m2}</table></section><section class=related><h4>{s2}</h4><p>{L6}</p><p>{s20}</p></section><div class=footer>{s10}</div>",
    "<div><h2>{L3}</h2></div><div><h1>{m7}</h1><p>{m50}</p><p>{m65}</p></div><div><h4>{L6}</h4><p>{s10} {L2}</p></div><div><h4>{L5}</h4><p>{s12} {L2}</p></div><p>{L3}</p>",
    "<div class=header><p>{L2} {L2} {L1}</p></div><div class=sidebar><article><h1>{m6}</h1><p>{m44}</p><p>{m31}</p><p>{m12}</p></article></div><div class=cookie-notice><p>{s25}</p>{L2}</div>",
    "<div class=topbar><p>{s4} {L2}</p></div><div class=entry><p>{m200}</p><p>{m1}</p><p>{m80} {K40}</p><p>{m2}</p></div><div class=widget><h3>{s2}</h3><p>{s22}</p></div><p>{L2} {L4}</p>",
    "<div>{L2}</div><div>{L2}</div><div><p>{m90}</p><p>{m60}</p></div><div class=comment><p>{s50}</p></div><div class=comment><p>{s9}</p></div><div>{L5}</div>",
    "<p>{m60}</p>", "<ul><li>{L3}<li>{L2}<li>{L4}</ul>", "<article><p>{m2}</p></article>", "<footer>{s12}</footer>", "<div>{L1} {L1}</div><h1>{m5}</h1><p>{m28}</p><p>{m5}</p><p>{m33}</p><div>{s3} {L3} {L3}</div>",
)
SLOT = re.compile(r"\{([msLK])([0-9]+)\}")


def filled(layout: str, rng: random.Random) -> str:
    """A page of a layout: main text in words of the letter m, the rest in words of s, numbers varied."""

    def words(m: re.Match) -> str:
        n, letter = int(m[2]), "m" if m[1] in "mK" else "s"
        n = n if n <= 3 and rng.random() < 0.6 else max(1, round(n * rng.uniform(0.4, 1.8)))
        text = " ".join(letter * rng.randint(1, 9) for _ in range(n))
        return f'<a href="/x">{text}</a>' if m[1] in "LK" else text

    return SLOT.sub(words, layout)


def labelled_rows(layouts: tuple[str, ...] = LAYOUTS, pages: int = 25, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rows of described() and labels of so many pages of each layout."""
    rng, x, y = random.Random(seed), [], []
    for layout in layouts:
        for _ in range(pages):
            bs = blocks(filled(layout, rng))
            x.append(described(bs))
            y += [int(b.text[0] == "m") for b in bs]
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first feature, then the least threshold. The first
    `plain` levels split by words and links only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4, plain: int = 2):
        self.label, self.at = int(2 * y.sum() >= len(y)), None
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = None
        for f in range(TEXT if plain > 0 else x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = c[:-1], c[-1] - c[:-1]
            cost = left * (1 - left / n) + right * (1 - right / (len(y) - n))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if ok.any():
                i = int(np.argmin(np.where(ok, cost, np.inf)))
                if best is None or cost[i] < best[0] - 1e-9:
                    best = float(cost[i]), f, float((v[i] + v[i + 1]) / 2)
        if best is None:
            return
        _, self.at, self.cut = best
        low = x[:, self.at] <= self.cut
        self.low, self.high = Tree(x[low], y[low], depth - 1, least, plain - 1), Tree(x[~low], y[~low], depth - 1, least, plain - 1)

    def predict(self, row) -> int:
        t = self
        while t.at is not None:
            t = t.low if row[t.at] <= t.cut else t.high
        return t.label


@lru_cache(1)
def tree() -> Tree:
    return Tree(*labelled_rows())


def main_text(page: str) -> str:
    """The main text of a page: its blocks that the tree takes for it, one for each line."""
    bs, t = blocks(page), tree()
    return "\n".join(b.text for b, row in zip(bs, described(bs).tolist(), strict=True) if t.predict(row))


def extract(df: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of whole pages and its code points. Null and empty pages give an empty text; clashing
    columns give way, others and repeated rows pass."""

    def make():
        def run(pages: list) -> list:
            got = [main_text((p or b"").decode(errors="replace")) for p in pages]
            return [got, [*map(len, got)]]

        return run

    return map_text(df, page, f"`{text}` string, `{n_chars}` long", make, keep)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages`; see extract() for nulls, repeats and clashing names, blocks() for broken pages."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {"op8_html": op8_html}
ORACLE_SQL: dict[str, str] = {}
